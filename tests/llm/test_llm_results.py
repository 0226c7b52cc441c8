"""Results that no SQL gives: held-out accuracy, brute force, and the stages' edge cases."""

import collections
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import jaccard, kernel, langid, mixing, pages, pii, quality, toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, scored, label):
    """(score, label) of the rows that no model was fitted on."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(f"{label} IS NOT NULL")
    rows = scored.where(kernel.held_out("doc_id", 5, 0)).join(labels, "doc_id").select("score", label).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def test_quality_of_rows_it_has_not_seen(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score, good = held_out(spark, quality.score(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))), "quality")
    assert (score[good == 1] >= 0.3).mean() > 0.97 and (score[good == 0] < 0.3).mean() > 0.85


def test_toxicity_of_rows_it_has_not_seen(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score, toxic = held_out(spark, toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))), "toxic")
    # six toxic rows, two of them in languages with a handful of fitted ones
    assert (score[toxic == 1] >= 0.5).mean() >= 0.5 and (score[toxic == 0] < 0.5).mean() > 0.95


def test_language_of_rows_it_has_not_seen(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs, langid.train(docs)).where(kernel.held_out("doc_id", 4, 2)).join(docs.select("doc_id", "lang", "text"), "doc_id")
    right = found.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def naive_score(model, text):
    """The quality score of one text, feature by feature."""
    s, raw = model.settings, (text or "").encode()
    families = []
    (c,) = kernel.chunks(pa.array([text]))
    starts, ends, _ = kernel.word_spans(c, kernel.WHITE)
    words = [int(kernel.span_hashes(c.buf, np.array([a]), np.array([b]))[0]) for a, b in zip(starts, ends)]
    families.append([w >> (64 - s.bits) for w in words])
    families.append([int(kernel.mix(np.array([(b - a) % 2**64], np.uint64))[0]) >> (64 - s.bits) for a, b in zip(words, words[1:])])
    codes = np.array([int.from_bytes(ch.encode(), "big") for ch in raw.decode() + " "], np.uint32)
    for n in s.grams:
        families.append([int(kernel.gram_hashes(codes[k : k + n], n, s.bits)[0]) for k in range(len(codes) - n + 1)])
    logit = model.bias + sum(sum(float(model.weight[b]) for b in f) / len(f) for f in families if f) / len(families)
    return 1 / (1 + math.exp(-logit))


def test_quality_scores_are_the_mean_of_all_features():
    texts = ["ein schöner Tag im März", "spam%%% spam%%%", "", None, "日本語 テキスト", "a"]
    model = quality.fit(texts[:2] * 20, [1, 0] * 20)
    got = model.score(pa.array(texts))
    assert got == pytest.approx([naive_score(model, t) for t in texts], abs=1e-5)


def test_toxicity_scores_are_maxima_over_all_windows():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, 12)) + (" bad" if n % 3 == 0 else "") for n in range(90)]
    model = toxicity.fit(texts, [int(n % 3 == 0) for n in range(90)])
    s = model.settings
    for text in [*texts[:5], "", "bad", "W1 w2!w3"]:
        (c,) = kernel.chunks(pa.array([text]))
        rows, _ = toxicity.word_buckets(c, s)
        vectors = [model.table[rows[:, k]].sum(0) for k in range(rows.shape[1])] + [np.zeros(s.dim, np.float32)] * 3
        best = []
        for width, filters, shift in zip(s.widths, model.kernels, np.split(model.shift, len(s.widths))):
            responses = [sum(vectors[k + j] @ filters[j] for j in range(width)) + shift for k in range(rows.shape[1])]
            best.append(np.maximum(np.max(responses, 0), 0) if responses else np.zeros(s.filters))
        logit = model.bias + np.concatenate(best) @ model.out
        assert model.score(pa.array([text]))[0] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4)


def test_personal_data_that_was_never_fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pii.train(spark, docs)
    contexts = [r[0] for r in docs.where("length(text) > 400").orderBy(F.desc("doc_id")).limit(60).select(F.substring("text", 100, 200)).collect()]
    made = pii.examples(pii.Settings(), contexts, seed=77)
    frame = spark.createDataFrame(pa.table({"doc_id": list(range(len(made))), "text": [m[0] for m in made]}))
    got = {r[0]: r[1] for r in pii.spans(frame, model).select("doc_id", pii.listed("spans")).collect()}
    right, wrong = collections.defaultdict(list), collections.defaultdict(list)
    for k, (_, g, good) in enumerate(made):
        generator = [*pii.GENERATORS][g]
        hit = any(x.startswith(pii.GENERATORS[generator][0] + ":") for x in got[k].split(","))
        (right if good else wrong)[generator].append(hit)
    assert min(np.mean(v) for v in right.values()) > 0.9 and max(np.mean(v) for v in wrong.values()) < 0.05
    # what the trees add in the documents themselves: every key after an assignment, and nothing in a text without one
    found = pii.spans(docs, model).select("_text", F.expr("exists(spans, x -> x.kind = 'secret')").alias("hit"))
    assert found.where(F.col("_text").rlike(r"token = \"[0-9a-f]{40}\"") & ~F.col("hit")).count() == 0
    assert found.where(~F.col("_text").rlike(r"[0-9a-zA-Z+/]{20}") & F.col("hit")).count() == 0


def test_balanced_rates_are_the_dual_solution(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    for own in by_source.values():
        size = np.array([r["size"] for r in own], float)
        target, unit = own[0]["target"], size[size > 0].mean()
        low, high = -1e4, 1e4
        for _ in range(300):  # brute force: the words grow with the multiplier
            x = (low + high) / 2
            rate = np.where(size > 0, np.minimum(3, np.exp(np.clip(x * size / unit, -700, 5))), 0)
            low, high = (x, high) if (rate * size).sum() < target else (low, x)
        assert np.abs(np.array([r["rate"] for r in own]) - rate).max() < 1e-5
        assert abs((np.array([r["copies"] for r in own]) * size).sum() - target) <= 0.005 * target  # about half a short document
        assert all(r["copies"] in (math.floor(r["rate"]) - 1, math.floor(r["rate"]), math.floor(r["rate"]) + 1, math.floor(r["rate"]) + 2) for r in own)
    assert len({r["rate"] for r in rows}) > 50  # documents of one source are tilted by size


BARE = "<html><head><title>t</title><script>x()</script></head><body><div><div><a href='/a'>Home</a></div><div><a href='/b'>All our stories</a></div></div><div>Buy the new thing now, only today</div><div><div>{head}</div><p>{one}</p><p>{two}</p></div><div>&copy; the paper, all rights reserved</div></body></html>"


def host(n):
    return [(k, f"http://a.org/news/{k:02d}", BARE.format(head=f"Head {k}", one=f"First line of story {k}.", two=f"Second line of story {k}, longer.")) for k in range(n)]


def test_differencing_alone_finds_the_article(spark):
    """No element, class, id or role says what is template."""
    frame = spark.createDataFrame(host(7), "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pages.extract(frame).collect()}
    for k in range(7):
        assert got[k]["text"] == f"Head {k}\nFirst line of story {k}.\nSecond line of story {k}, longer."
        assert got[k]["n_deleted"] == 4
    assert all("rights reserved" in r["text"] and r["n_deleted"] == 0 for r in pages.extract(frame, reach=0).collect())


def test_differencing_against_brute_force(spark):
    """Every page of a small host against all pages before and after it, by a plain longest common subsequence."""

    def common(a, b):
        best = [[()] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + (i,) if x == y else max(best[i][j + 1], best[i + 1][j], key=len)
        return set(best[-1][-1])

    rows = host(6)
    lines = [[t for t, _ in pages.all_lines(h)] for _, _, h in rows]
    want = {}
    for k, own in enumerate(lines):
        near = sorted((o for o in range(len(rows)) if o != k and abs(o - k) <= 2), key=lambda o: (-pages.nearness(rows[k][1], rows[o][1]), o))
        shared = [common(own, lines[o]) for o in near]
        want[k] = "\n".join(t for i, t in enumerate(own) if i not in shared[0])
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_differencing_deletes_template_lines_of_the_tables(spark):
    frame = spark.read.parquet(f"{SF}/pages.parquet")
    assert pages.extract(frame).where("n_deleted > 0").count() > 50


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("_row", "copies", "size", "target", "taken", "score", "component_id", "spans", "_text", "_m", "_tie", "base")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    rows = docs.collect()
    extra = [(None, None, None, None, None), (9001, "", "en", "src1", 0), (9002, None, "en", "src1", None), (9003, "word " * 60_000, "en", None, 300_000), (9003, "word " * 60_000, "en", None, 300_000), (None, "mail a@b.cc " * 30, None, "src2", 5), tuple(rows[3]), tuple(rows[3])]
    frame = spark.createDataFrame([tuple(r) for r in rows] + extra, DOCS)
    for name in CLASH:
        frame = frame.withColumn(name, F.lit(f"mine {name}"))
    return frame


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, SF)
    assert out.columns[: len(odd.columns)] == odd.columns
    rows = out.collect()
    assert all(r[f] == f"mine {f}" for r in rows for f in CLASH)
    assert stage(spark, odd.limit(0), SF).count() == 0
    n = odd.count()
    if name == "near_copies":
        kept = collections.Counter(r["text"] for r in rows)
        assert kept["word " * 60_000] == 1 and kept[odd.collect()[3]["text"]] == 1
        assert sum(1 for r in rows if not (r["text"] or "").strip()) == 3
        texts = [r["text"] for r in odd.collect()]
        keyed = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        assert len(rows) == jaccard.groups(keyed).select("component_id").distinct().count()
    if name == "personal_data":
        assert len(rows) == n and not any("a@b.cc" in (r["text"] or "") for r in rows) and sum(r["text"] is None for r in rows) == 2
    if name == "mixing":
        assert set(out.columns[len(odd.columns) :]) == {"copies_", "size_", "target_", "taken_"}
        assert all(r["taken_"] == r["size_"] * r["copies_"] > 0 for r in rows)
    if name == "decontamination":
        con = duckdb.connect()
        items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for (t,) in con.sql(f"SELECT text FROM '{SF}/benchmark.parquet' WHERE text IS NOT NULL").fetchall()]
        windows = {tuple(w[i : i + 13]) for w in items for i in range(max(1, len(w) - 12)) if w}

        def bad(text):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
            hit = set()
            for size in {len(x) for x in windows}:
                for i in range(len(w) - size + 1):
                    if tuple(w[i : i + size]) in windows:
                        hit.update(range(i, i + size))
            return bool(hit) and 20 * len(hit) >= len(w)

        assert collections.Counter(r["text"] for r in rows) == collections.Counter(r["text"] for r in odd.collect() if not bad(r["text"]))


def test_operators_on_long_texts(spark):
    """One text of 1.5 million characters among short ones: all scored, none cut."""
    long = "the quick brown fox jumps over the lazy dog " * 34_000
    frame = spark.createDataFrame([(1, long, "en", "s"), (2, "the quick fox", "en", "s"), (3, long + "x", "en", None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in (1, 2, 3)], "doc_id long, quality int, toxic int")
    assert toxicity.score(frame, toxicity.train(frame, labels)).count() == 3
    assert quality.score(frame, quality.train(frame, labels)).count() == 3
    assert langid.predict(frame, langid.train(frame)).count() == 3
    assert {r["doc_id"]: r["size"] for r in mixing.mix(frame).collect()} == {1: 306_000, 2: 3, 3: 306_001}
    page = spark.createDataFrame([(1, "http://a.b/c", f"<article><p>{long}</p></article>")], "page_id long, url string, html string")
    assert pages.extract(page).first()["text"] == long.strip()
