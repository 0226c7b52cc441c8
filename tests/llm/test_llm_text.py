"""The text operators against brute force, with the edge cases that their docstrings define."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import contamination, jaccard, kernel, langid, mixing, pii, quality, repeats, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string, _row string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, nulls, blanks, one long text, a repeated row, clashing names."""
    rng = random.Random(4)
    base = [words(rng, rng.randrange(8, 160)) for _ in range(30)]
    passage = words(rng, 70)
    texts = [*base, base[0], base[0], None, "", " \n", "one two", "One  two", base[1].upper(), f"{base[2]} {passage}", f"{passage} {base[3]}", words(rng, 4000), "é" * 300, "ab " * 200, "ß\x00" * 150]
    for b in base[4:10]:
        w = b.split()
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), " ".join([*w, "tail"])]
    rows = [(k, t, None, None, None, None) for k, t in enumerate(texts)]
    rows += [rows[5], (None, base[7], "x", "y", "z", "r")]
    return spark.createDataFrame(rows, DOCS)


def held(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_words_and_hashes():
    texts = pa.array([None, "", " a  bc ", "é d", "x" * 10])
    (c,) = kernel.chunks(texts)
    starts, ends, firsts = kernel.word_spans(c, kernel.WHITE)
    assert firsts.tolist() == [0, 0, 0, 2, 4, 5]
    assert [c.buf[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["a", "bc", "é", "d", "x" * 10]
    assert len(list(kernel.chunks(texts, 4))) > 1
    same = kernel.span_hashes(c.buf, starts, ends)
    assert len(set(same.tolist())) == 5


def contaminated(docs, items, size=13):
    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    out = []
    for d, t in docs:
        w, hit, names = tokens(t), set(), set()
        for i, item in items:
            p = tokens(item)
            m = min(len(p), size)
            for a in range(len(p) - m + 1 if p else 0):
                for k in range(len(w) - m + 1):
                    if w[k : k + m] == p[a : a + m]:
                        hit.update(range(k, k + m))
                        names.add(str(i))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination(spark, docs):
    rows = held(docs)
    source = dict(r for r in rows if r[0] is not None)
    items = [(1, source[0]), (10, source[12].upper() + "!"), (2, "one two"), (3, None), (4, "..."), (5, source[20]), (6, "ééé nothing"), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block in (200_000, 20):  # one slice, and many
        got = contamination.report(contamination.hits(docs, bench, block=block)).select(names)
        assert sorted((tuple(r) for r in got.collect()), key=str) == contaminated(rows, items)
    assert contamination.hits(docs.limit(0), bench).count() == 0
    assert contamination.report(contamination.hits(docs, bench.limit(0))).where("contaminated OR n_items > 0").count() == 0


def linked(rows, num=80, den=100):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return sorted(((d, len(sets[k]), least.get(root(k)) if sets[k] else d) for k, (d, _) in enumerate(rows)), key=str)


def test_jaccard(docs):
    got = jaccard.groups(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == linked(held(docs))
    assert jaccard.groups(docs.limit(0)).count() == 0


def test_jaccard_with_a_group_of_near_copies(spark):
    """Copies with few and with many changes: links, and look-alikes that don't link, in lists with frequent shingles."""
    rng = random.Random(9)
    base = words(rng, 60).split()
    rows = []
    for k in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((k, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.groups(frame, jaccard.Settings(frequent=500))
    assert sorted((tuple(r) for r in got.collect()), key=str) == linked(rows)


def cut(rows, size=200):
    raw = [(d, (t or "").encode()) for d, t in rows]
    n = Counter(r[k : k + size] for _, r in raw for k in range(len(r) - size + 1))
    out = []
    for d, r in raw:
        left, gone, spans = repeats.cut(r, [(k, k + size) for k in range(len(r) - size + 1) if n[r[k : k + size]] > 1])
        out.append((d, len(r), gone, spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("s", [repeats.Settings(), repeats.Settings(hot=2), repeats.Settings(hot=1, widths=(64, 8, 1)), repeats.Settings(batch_bytes=1 << 10, task_bytes=1 << 13)])
def test_repeats(docs, s):
    got = repeats.removed(docs, s)
    assert sorted((tuple(r) for r in got.collect()), key=str) == cut(held(docs))
    if s.hot > 10:
        assert repeats.removed(docs.limit(0), s).count() == 0


def test_repeats_of_hot_keys(spark):
    """A passage that many texts share, whole or in part, amid other words, and strings that repeat themselves."""
    rng = random.Random(5)
    passage = words(rng, 90)
    rows = [(k, words(rng, rng.randrange(30)) + passage[rng.randrange(60) : len(passage) - rng.randrange(60)] + words(rng, rng.randrange(30))) for k in range(40)]
    rows += [(50 + k, "ab" * (90 + 7 * k) + "é" + passage[: 40 * k]) for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for s in (repeats.Settings(hot=3), repeats.Settings(hot=3, widths=(16,)), repeats.Settings(hot=1, widths=(177, 20, 1))):
        assert sorted((tuple(r) for r in repeats.removed(frame, s).collect()), key=str) == cut(rows)


def test_family_marks_windows_of_all_batches():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(60)).encode() for _ in range(40)]
    texts += [t[5:50] for t in texts[:10]]
    family, spans = repeats.Family(12, sum(map(len, texts))), []
    for k in range(0, len(texts), 3):
        spans += family.add(texts[k : k + 3])
    n = Counter(t[k : k + 12] for t in texts for k in range(len(t) - 11))
    for t, (a, m) in zip(texts, spans, strict=True):
        assert family.marked(a, m).tolist() == [n[t[k : k + 12]] > 1 for k in range(len(t) - 11)]


def base_spans(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x[-4000:]) <= 255 and not x[:-4000].strip("0") for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


TEXTS = [
    "mail a.b@c.de, x@y@z.org and q@w.co.uk_r@s.tt now",
    "😀 é a@b.cc 😀 1.2.3.4 and 256.1.1.1, 1.2.3.4.5.6.7.8, 000255.1.1.1 007.1.1.1",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 5500000000000004-9 0000 0000 0000",
    "+1 (415) 555-2671. +44 20 7946 0958) +123 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 +1 1111111 ",
    "4111 1111 1111 1111 +1 4111 1111 1111 111 1.1.1.1@b.cc",
    "9" * 30_000 + ".1.1.1 " + "a" * 30_000 + "@",
    "a@" + "b." * 6000 + "c",
    "write to john (at) mail (dot) com or call 555-123-4567, iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789",
    "",
    None,
]


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.train(spark)


def test_personal_data(spark, pii_model):
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], None)], "doc_id long, text string, spans string")
    rows = pii.spans(frame, pii_model).select("doc_id", pii.listed("base").alias("b"), pii.listed("spans").alias("s")).collect()
    for r in rows:
        t = TEXTS[r["doc_id"] or 0]
        assert r["b"] == base_spans(t or "")
        assert set(filter(None, r["b"].split(","))) <= set(r["s"].split(","))
    extra = {x.split(":")[0] for r in rows if r["doc_id"] == 7 for x in r["s"].split(",")}
    assert extra == {"email", "phone", "iban", "id"}
    assert pii.spans(frame.limit(0), pii_model).count() == 0


def test_redaction(spark, pii_model):
    frame = spark.createDataFrame([(1, "see a@b.cc or 1.2.3.4!", "k"), (2, None, "l"), (3, "nothing", None)], "doc_id long, text string, _text string")
    assert [tuple(r) for r in pii.redact(frame, pii_model).orderBy("doc_id").collect()] == [(1, "see [EMAIL] or [IP]!", "k"), (2, None, "l"), (3, "nothing", None)]


def test_no_python_on_executors(spark, pii_model):
    plan = pii.spans(spark.createDataFrame([(1, "a")], "doc_id long, text string"), pii_model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(k, words(rng, rng.choice([3, 20, 20, 90])) if k % 17 else None, None if k % 50 == 0 else f"s{'a' if k % 3 else k % 5}") for k in range(400)]
    rows.append(rows[7])
    frame = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size int")
    got = [r.asDict() for r in mixing.mix(frame).collect()]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sizes if weight[s] * level >= 3 * sizes[s]}
        if more == full:
            break
        full = more
    for s in order:
        own = [r for r in got if r["source"] == s]
        target = min(3 * sizes[s], weight[s] * level)
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - target) < 1e-6 for r in own)
        assert abs(sum(r["size"] * r["copies"] for r in own) - target) <= 10
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 3 for r in got)
    again = mixing.mix(frame.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in got)
    assert mixing.mix(frame.limit(0)).count() == 0
    assert mixing.mix(frame.withColumn("text", F.lit(None).cast("string"))).where("copies > 0 OR target > 0").count() == 0


def labelled(spark, n=500):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        toxic, junk = k % 5 == 0, k % 7 == 0
        w = words(rng, rng.randrange(5, 60)).split()
        if junk:
            w = [x + "%%%" for x in w]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "scum"])
        rows.append((k, " ".join(w), rng.choice(["en", "fr", None]), int(not junk), int(toxic)))
    rows += [(n, None, None, 1, 0), (n + 1, "", "en", None, None), (None, "w1", None, 1, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int")
    return frame.withColumn("score", F.lit("clash")).select("doc_id", "text", "lang", "score"), frame.select("doc_id", "quality", "toxic")


@pytest.mark.parametrize(("operator", "column"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_hold_out(spark, operator, column):
    docs, labels = labelled(spark)
    model = operator.train(docs, labels)
    scored = operator.score(docs, model)
    assert scored.count() == docs.count() and scored.where("NOT score BETWEEN 0 AND 1 OR score IS NULL").count() == 0
    out = scored.where(kernel.held_out("doc_id", 5, 0)).join(labels, "doc_id").where(f"{column} IS NOT NULL")
    right = out.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col(column)).cast("int"))).first()[0]
    assert right > 0.95
    assert operator.score(docs.limit(0), model).count() == 0
    none = operator.train(docs, labels.limit(0))
    assert operator.score(docs, none).agg(F.min("score")).first()[0] == pytest.approx(0.5)
    one = operator.train(docs, labels.where(f"{column} = 1"))
    assert operator.score(docs, one).agg(F.min("score")).first()[0] > 0.9


def test_quality_keep(spark):
    docs, labels = labelled(spark, 100)
    model = quality.train(docs, labels)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality.score(docs, model).where("score >= 0.3").count()


def test_toxic_thresholds_by_language(spark):
    docs, labels = labelled(spark, 1500)
    model = toxicity.train(docs, labels)
    assert set(model.thresholds) <= {"en", "fr"} and 0.2 <= model.threshold <= 0.8
    out = toxicity.flagged(docs, model)
    assert out.columns == ["doc_id", "score", "flagged"] and out.where("flagged IS NULL").count() == 0 and out.count() == docs.count()


def test_language(spark):
    rng = random.Random(8)
    letters = {"xx": "abcde", "yy": "fghij", "zz": "àéîöu"}
    rows = []
    for k in range(300):
        lang = rng.choice(list(letters))
        rows.append((k, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(20)), lang))
    rows += [(300, None, "xx"), (301, "123 !", "yy"), (302, "", None), (None, "abcde", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[k]["lang_pred"] == lang and not got[k]["ambiguous"] for k, _, lang in rows[:300])
    assert all((got[k]["lang_pred"], got[k]["score"], got[k]["ambiguous"]) == ("und", 0.0, True) for k in (300, 301, 302))
    nothing = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    single = langid.train(docs.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in langid.predict(docs, single).collect()} == {"xx", "und"}


@pytest.mark.parametrize("k", [2, 4, 7, 8, 40])
def test_codewords_differ(k):
    code = langid.codewords(k, langid.Settings())
    assert min((code[a] != code[b]).sum() for a in range(k) for b in range(a)) >= (1 if k == 2 else 2)


@pytest.mark.parametrize(("operator", "column"), [(toxicity, "toxic"), (quality, "quality")])
def test_scores_keep_the_true_shares_when_classes_are_sampled(spark, operator, column):
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("the same words in each").alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias(column))
    # both classes exceed the bound; the words tell nothing, so the score is the share
    model = operator.train(docs, labels, operator.Settings(sample=60))
    assert operator.score(docs, model).agg(F.max("score")).first()[0] == pytest.approx(0.1, abs=0.05)


def test_pii_learns_from_all_documents(spark, monkeypatch):
    """Every candidate of every text counts, equal texts once, however few documents they weigh as; rounding leaves none out."""
    rows = [(k, f"api_key = {'aB3' * (4 + k % 9)}{k:04d} and token: {'x9Q' * 4}{k % 7}") for k in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:20], (99, None), (100, "nothing")], "doc_id long, text string")
    seen = []
    real = pii.boost
    monkeypatch.setattr(pii, "boost", lambda *args: seen.append(args) or real(*args))
    pii.train(spark, docs, pii.Settings(documents=10))
    pii.train(spark, docs, pii.Settings(documents=10, vectors=8))
    every = pii.candidates(docs.where("text IS NOT NULL").distinct().select(F.col("text").alias("_text")).distinct(), "_text").agg(F.sum(F.size("_candidates"))).first()[0]
    found = [(a[0][a[4] != 1], a[4][a[4] != 1]) for a in seen]  # made spans weigh 1, the others 10 / 61 each
    assert every > 120 and all(w.sum() * 61 / 10 == pytest.approx(every) for _, w in found)
    assert len(found[1][0]) < len(found[0][0]) and (found[1][0].max(0) >= found[0][0].max(0)).all()


def test_release_trims_the_driver(spark):
    """What the JVM's threads freed outside its heap goes back as well (JDK 17.0.9 and later on glibc)."""
    assert "Trim native heap" in kernel.trim_jvm(spark)


def test_toxicity_thresholds_come_from_all_clean_rows(spark, monkeypatch):
    """Rows beyond the sample that is fitted on count as well: thresholds as by brute force over all that weren't fitted."""
    rng = random.Random(5)
    text = lambda bad: words(rng, 12) + (f" bad{rng.randrange(3)}" if bad else "")
    rows = [(k, text(k % 4 == 0 or k % 9 == 1), ("aa", "bb", None)[k % 3]) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(900)], "doc_id long, toxic int")
    seen, real = [], toxicity.calibrate_all
    monkeypatch.setattr(toxicity, "calibrate_all", lambda *args: seen.append(args[3]) or real(*args))
    s = toxicity.Settings(sample=40, steps=200, clean=0.1)
    model = toxicity.train(docs, labels, s)
    (fitted,) = seen
    kept = {r[0] for r in docs.where(~kernel.held_out("doc_id", 5, 0)).collect()}
    assert 40 < len(fitted) < 80 and set(fitted) <= kept
    clean = [r for r in rows if r[0] % 4 and r[0] in kept and r[0] not in fitted]
    scores = model.score(pa.array([r[1] for r in clean]))

    def lowest(lang=None):
        own = [math.ceil(min(max(x, 0.2), 0.8) * 10_000) for x, r in zip(scores, clean, strict=True) if lang in (None, r[2])]
        return min(max(sorted_place(own, 1 - s.clean) / 10_000 + 1e-6, 0.2), 0.8)

    def sorted_place(own, share):
        own, at = sorted(own), share * (len(own) - 1)
        low = own[int(at)]
        return low + (own[min(int(at) + 1, len(own) - 1)] - low) * (at - int(at))

    assert len(clean) > 400 and model.threshold == pytest.approx(lowest())
    assert model.thresholds == {lang: pytest.approx(lowest(lang)) for lang in ("aa", "bb")}
