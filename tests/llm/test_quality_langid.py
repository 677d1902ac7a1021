import math
import re
import zlib

import numpy as np
import pytest

from siftline.llm import langid as li
from siftline.llm import quality as q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


EDGE = [
    None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 30, "\n".join(["same line here."] * 5), "##$$ <b> & | %*",
    "é ü 😀 " * 10, " nbsp here" * 9, "long text. " * 20_000, "\n\n a.\n\n a.\n b", " ".join(f"w{i}" for i in range(50)) + " " + " ".join(f"w{i}" for i in range(8)),
]


def test_base_figures(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(EDGE)] + [(None, "x", 1), (3, "a", 1)], "doc_id long, text string, words int")
    got = q.quality_report(docs).collect()
    assert len(got) == len(EDGE) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(EDGE[r.doc_id]), EDGE[r.doc_id] and EDGE[r.doc_id][:50]
            assert not (r.base_failed and r.kept)
    assert q.quality_report(docs.limit(0)).collect() == []


def test_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in q.quality_report(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])


def test_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = q.quality_report(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)


@pytest.mark.parametrize("mark", ["|", "a|", "!!", "Home > ", "!", ">·"])
def test_lines_of_many_marks(spark, mark):
    # A matcher that recurses for each repetition overflows its stack on such lines.
    rows = [(i, unit + end) for i, n in enumerate((2_000, 200_000, 5_000_000 // len(mark))) for end in (".", "") for unit in [mark * n]]
    got = q.quality_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.clean_chars for r in got} == {0} and {r.line_chars for r in got} == {len(t) for _, t in rows}


def test_counts_of_marks(spark):
    from pyspark.sql import functions as F

    menu = "All news of today · and of the week before · in order"
    rows = [(menu + ".", True), (menu + " · or not.", False), ("so!! much!! news.", True), ("so!! much!! news!!", False), ("wow!!!!! fine!", True), ("ends well.\r", True)]
    got = spark.createDataFrame(rows, "x string, ok boolean").select("x", "ok", q.line_passes(F.col("x")).alias("is")).collect()
    assert [(r.x, r["is"]) for r in got] == rows


def test_stays_native(spark):
    plan = q.quality_report(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


@pytest.mark.parametrize(
    "line,ok",
    [
        ("A plain sentence with words.", True),
        ("no end mark", False),
        ("Home | News | Sport | More.", False),
        ("SHOUTING ALL THE WORDS IN HERE NOW.", False),
        ("we%%% use*** many&&& signs$$$.", False),
        ("All rights reserved.", False),
        ("Eine Zeile auf Deutsch, ß.", True),
        ('He said "yes."', True),
    ],
)
def test_line_rules(spark, line, ok):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(line,)], "x string").select(q.line_passes(F.col("x"))).first()[0] is ok


def test_cleaning(spark):
    text = "Good line one here.\nHome | A | B | C\n\nMore words in a fine sentence follow here now, and this one goes on with words of its own to be long."
    docs = spark.createDataFrame([(1, text), (2, "Home | A | B | C\n" * 20)], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in q.clean_documents(docs).collect()] == [(1, text.replace("Home | A | B | C\n", ""))]


# ---------------------------------------------------------------- language


def test_features_are_counts(monkeypatch):
    monkeypatch.setattr(li, "CHUNK", 5)
    small = li.features("Ab1 c" * 9)
    monkeypatch.setattr(li, "CHUNK", 1 << 20)
    whole = li.features("Ab1 c" * 9)
    assert np.array_equal(small[0], whole[0]) and np.array_equal(small[1], whole[1])
    n = 5 * 9
    assert whole[1].sum() == n + (n - 1) + (n - 2)
    assert li.features("12 %%") is None and li.features(None) is None and li.features("") is None


def test_ftrl_learns_and_is_sparse():
    rng, model = np.random.default_rng(0), li.Ftrl(2)
    for _ in range(600):
        y = int(rng.integers(2))
        at = np.array([y, 2 + int(rng.integers(50))])
        model.learn(at, np.array([0.9, 0.4]), y)
    w = model.weights()
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    assert (w[60:] == 0).all()


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in li.softmax(logits)])
    assert abs(li.temperature(logits * 3, labels) - 3) < 0.4
    assert li.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in li.identify(docs, sample_rows=600).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(found) == len(rows)
    out = [r for r in rows if found[r.doc_id].held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == found[r.doc_id].held_out for r in rows)
    right = [found[r.doc_id].lang_pred == r.lang for r in out]
    assert np.mean(right) >= 0.97
    assert abs(np.mean([found[r.doc_id].score for r in out]) - np.mean(right)) < 0.05
    assert all(0 <= r.score <= 1 and math.isfinite(r.score) for r in found.values())


def test_edge_cases(spark):
    rows = [(i, "the cat and the hat", "en", 1) for i in range(30)] + [(100 + i, "der Hund und die Katze", "de", 1) for i in range(30)]
    rows += [(200, None, "en", 1), (201, "12 34", "de", 1), (202, "the hat", None, 1), (None, "die Katze", "de", 1), (203, "", None, 1), (203, "Hund " * 50_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = li.identify(docs).collect()
    assert len(got) == len(rows)
    pred = {r.doc_id: r.lang_pred for r in got if r.doc_id != 203}
    assert (pred[200], pred[201], pred[202], pred[None], pred[0], pred[100]) == ("und", "und", "en", "de", "en", "de")
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert li.identify(docs.limit(0)).collect() == []
    unknown = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in li.identify(unknown).collect()] == [("und", 0.0)]
    kept = li.accepted(docs, 0.4)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 100, 202} and kept.where("doc_id in (200, 201)").count() == 0


def test_lang_is_no_input_of_a_prediction(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = li.fit(docs)
    a = {r.doc_id: r.lang_pred for r in li.predict(docs, model).collect()}
    b = {r.doc_id: r.lang_pred for r in li.predict(docs.drop("lang", "source"), model).collect()}
    assert a == b


def plain_features(text):
    letters = [c if c.isalpha() else " " for c in (text or "").lower()]
    if not any(c.isalpha() for c in letters):
        return None
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            h = n
            for c in letters[i : i + n]:
                h = ((h ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            counts[h % li.BUCKETS] = counts.get(h % li.BUCKETS, 0) + 1
    return counts


def plain_model(rows):
    """Brute force: dictionaries and loops over single weights; rows are (text, lang)."""
    rows = [(t, lang, plain_features(t)) for t, lang in rows]
    seen = {}
    for _, _, f in rows:
        for b in f:
            seen[b] = seen.get(b, 0) + 1
    langs = sorted({lang for _, lang, _ in rows})
    idf = lambda b: math.log((1 + len(rows)) / (1 + seen.get(b, 0))) + 1

    def vector(f):
        x = {b: (1 + math.log(c)) * idf(b) for b, c in f.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / norm for b, v in x.items()}

    z, n = {}, {}

    def weight(b, k):
        v = z.get((b, k), 0.0)
        return 0.0 if abs(v) <= li.L1 else (math.copysign(li.L1, v) - v) / ((li.BETA + math.sqrt(n.get((b, k), 0.0))) / li.ALPHA + li.L2)

    def scores(x, t=1.0):
        s = [sum(v * weight(b, k) for b, v in x.items()) / t for k in range(len(langs))]
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    rows.sort(key=lambda r: (zlib.crc32(r[0].encode()), langs.index(r[1])))
    order = np.random.default_rng(li.SEED).permutation(len(rows)).tolist()
    kept, used = order[:: li.CALIBRATE], [i for k, i in enumerate(order) if k % li.CALIBRATE]
    for _ in range(li.EPOCHS):
        for i in used:
            x = vector(rows[i][2])
            p = scores(x)
            steps = [((b, k), v * (p[k] - (langs[k] == rows[i][1])), weight(b, k)) for b, v in x.items() for k in range(len(langs))]
            for at, g, w in steps:
                before = n.get(at, 0.0)
                n[at] = before + g * g
                z[at] = z.get(at, 0.0) + g - (math.sqrt(n[at]) - math.sqrt(before)) / li.ALPHA * w
    logits = np.array([[sum(v * weight(b, k) for b, v in vector(rows[i][2]).items()) for k in range(len(langs))] for i in kept])
    t = li.temperature(logits, np.array([langs.index(rows[i][1]) for i in kept]))

    def predict(text):
        f = plain_features(text)
        if f is None:
            return "und", 0.0
        p = scores(vector(f), t)
        return langs[p.index(max(p))], max(p)

    return predict


def test_identify_is_brute_force(spark):
    words = {"en": "the cat sat on a mat and saw her hat", "de": "der Hund lief über die Straße und bellte laut", "fr": "le chat est sur la table près du mur"}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 6)), lang) for i in range(80) for lang in [("en", "de", "fr")[i % 3]]]
    rows += [(200, None, "en"), (201, "12", "de"), (202, "mat Hund table", None), (None, "le mur", "de"), (203, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    learned = [(t, lang) for i, t, lang in rows if i is not None and lang and plain_features(t) and not held(i)]
    assert len(learned) >= 50  # enough for a temperature
    predict = plain_model(learned)
    for r, (i, t, _) in zip(sorted(li.identify(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        lang, score = predict(t)
        assert (r.doc_id, r.held_out, r.lang_pred) == (i, held(i), lang) and abs(r.score - score) < 1e-6


def test_sample_is_bounded(spark):
    # A third of the rows are one repeated row, another third share its doc_id.
    rows = [(1, "same text", "en")] * 1000 + [(1, f"other {i}", "en") for i in range(1000)] + [(2 + i, f"text {i}", "ende"[2 * (i % 2) :][:2]) for i in range(1000)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = li.draw(known, {"en": 2500, "de": 500}, 200).collect()
    per = {lang: sum(r.lang == lang for r in got) for lang in ("en", "de")}
    assert per["de"] == 100 and 50 <= per["en"] <= 100 and sum(r.text == "same text" for r in got) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, li.draw(known.repartition(2), {"en": 2500, "de": 500}, 200).collect()))


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(li, "MAX_LANGUAGES", 3)
    rows = [(i, "some words", f"l{i % 4}") for i in range(40)]
    with pytest.raises(ValueError):
        li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
