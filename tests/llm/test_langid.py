import math
import random
from collections import Counter

import numpy as np

from quarry.llm import langid, queries

STEMS = {"en": ["the", "of", "tion", "ing", "wh", "ea"], "fr": ["le", "eux", "é", "oi", "que", "ou"], "ru": ["ст", "но", "ени", "пр", "ов", "ра"]}


def text(lang, n):
    return " ".join("".join(random.choices(STEMS[lang], k=random.randint(1, 3))) for _ in range(n))


def rows():
    random.seed(6)
    return [(i, text(x := random.choice(list(STEMS)), random.randint(5, 60)), x) for i in range(400)]


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    from itertools import product

    scores, lengths = rng.normal(size=(30, 3)).astype(np.float32), np.array([4, 0, 6, 1])
    ids = rng.integers(0, 30, lengths.sum())
    got, at = langid.viterbi(scores, ids, lengths, 0.8), 0
    for n in lengths.tolist():
        s = scores[ids[at : at + n]]
        value = lambda x, s=s, n=n: sum(float(s[i, x[i]]) for i in range(n)) - 0.8 * sum(x[i] != x[i - 1] for i in range(1, n))
        assert abs(value(got[at : at + n].tolist()) - max(map(value, product(range(3), repeat=n)))) < 1e-4
        at += n


def test_held_out_accuracy_and_odd_texts(spark, tmp_path):
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 -- !?", "fr"), (1003, "the of " * 40_000, None), (1003, "the of " * 4, "en"), (None, "le eux", None)]
    spark.createDataFrame([(*r, "x") for r in rows() + odd], "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op2_language_id(spark, str(tmp_path)).collect()
    lang = {i: x for i, _, x in rows()}
    own = [r for r in found if r.doc_id in lang and r.held_out]
    assert len(found) == len(lang) + len(odd) and len(own) > 50
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in own]) > 0.97
    by = {r.doc_id: r for r in found}
    assert [(by[i].lang_pred, by[i].score, by[i].spans) for i in (1000, 1001, 1002)] == [("und", 0.0, [])] * 3
    assert by[1003].lang_pred == "en" and all(0 <= r.score <= 1 for r in found)


def test_spans_of_mixed_text(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = langid.fit(docs)
    mixed = [(1, f"{text('en', 30)}. {text('fr', 25)}\n{text('ru', 20)}")]
    (r,) = langid.identify(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()
    assert [s.lang for s in r.spans] == ["en", "fr", "ru"]
    assert r.spans[0].start == 0 and abs(r.spans[1].start - 30) <= 2 and abs(r.spans[2].start - 55) <= 2 and r.spans[2].end == 75


def test_nothing_to_learn_from(spark, tmp_path):
    spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.lang_pred for r in queries.op2_language_id(spark, str(tmp_path)).collect()] == ["und"]
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert queries.op2_language_id(spark, f"{tmp_path}/e").count() == 0


def test_letters_are_those_of_unicode(spark):
    assert langid.words("½ ² ① Ⅷ 12 _ -") == [] and langid.words("x² हिन्दी नमस्ते é naïve") == ["x", "हिन्दी", "नमस्ते", "é", "naïve"]
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "½ ²"), (2, "① 12"), (3, "the ² of")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in langid.identify(odd, langid.fit(docs)).orderBy("doc_id").collect()] == [("und", 0.0), ("und", 0.0), ("en", 1.0)]


def test_rare_languages_are_learned_at_any_size(spark):
    docs = spark.createDataFrame([(i, text("en", 3), "en") for i in range(5000)] + [(9000 + i, text("fr", 30), "fr") for i in range(3)], "doc_id long, text string, lang string")
    model = langid.fit(docs, most=200)
    assert model.langs == ["en", "fr"]
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, text("fr", 40))], "doc_id long, text string"), model).collect()] == ["fr"]


def plain_model(train, smoothing=0.2):
    """Log shares by language, order and bucket, and the scripts of each, in plain Python."""
    counts, scripts = {}, {}
    for _, t, lang in train:
        for w in langid.words(t):
            scripts.setdefault(lang, Counter())[script(w)] += 1
            for k, g in grams(w):
                counts.setdefault(lang, Counter())[k, g] += 1
    table = {}
    for lang, c in counts.items():
        for k in range(len(langid.ORDERS)):
            total = sum(n for (o, _), n in c.items() if o == k) + smoothing * langid.BUCKETS
            table[lang, k] = (lambda g, c=c, k=k, total=total: math.log((c[k, g] + smoothing) / total))
    return sorted(counts), scripts, table


def script(word):
    return next((s for a, s in reversed(langid.RANGES) if ord(word[0]) >= a), "Latin")


def grams(word):
    """(order, bucket) of the byte n-grams of a word between blanks; a gram may begin or end with a blank."""
    data = f" {word} ".encode()
    for k, n in enumerate(langid.ORDERS):
        for i in range(len(data) - n + 1):
            h = 0
            for b in data[i : i + n]:
                h = (h * 1_000_003 + b) % 2**64
            yield k, (h * 0x9E3779B97F4A7C15 % 2**64) >> 48


def plain_identify(model, t, penalty=9.0, floor=6.0):
    langs, scripts, table = model
    found = langid.words(t)
    best = [0.0] * len(langs)
    back = []
    for w in found:
        may = [scripts[x][script(w)] >= langid.LEAST_SHARE * sum(scripts[x].values()) for x in langs]
        may = may if any(may) else [True] * len(langs)
        score = [sum(table[x, k](g) for k, g in grams(w)) for x in langs]
        top = max(s for s, m in zip(score, may) if m)
        own = [max(s - top, -floor) if m else -2 * floor for s, m in zip(score, may)]
        if back:
            b = max(range(len(langs)), key=lambda i: best[i])
            back.append([i if best[i] >= best[b] - penalty else b for i in range(len(langs))])
            best = [max(best[i], best[b] - penalty) for i in range(len(langs))]
        else:
            back.append(list(range(len(langs))))
        best = [x + y for x, y in zip(best, own)]
    state, labels = max(range(len(langs)), key=lambda i: best[i]), []
    for step in reversed(back):
        labels.append(state)
        state = step[state]
    labels.reverse()
    letters = Counter()
    for w, x in zip(found, labels):
        letters[langs[x]] += len(w)
    return max(sorted(letters), key=letters.__getitem__), max(letters.values()) / sum(letters.values())


def test_whole_operator_equals_plain_python(spark):
    train, odd = rows()[:150], [(i, f"{text('en', 12)} {text('fr', 9)} {text('ru', 7)} {text('en', 1)}", None) for i in range(500, 540)]
    model = plain_model(train)
    docs = spark.createDataFrame(rows()[150:260] + odd, "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))).collect()
    for r in found:
        lang, share = plain_identify(model, r.text)
        assert r.lang_pred == lang and abs(r.score - share) < 1e-9, r.doc_id
