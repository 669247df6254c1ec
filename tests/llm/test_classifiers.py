import random
import zlib

import numpy as np
from conftest_llm import prose

from riskvq.llm import common, language, quality, toxicity


def crc(i, k):
    return zlib.crc32(str(i).encode()) % k


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, score double")


def corpus(n=240):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(n):
        text, bad, toxic = prose(rng, rng.randrange(20, 90)), rng.random() < 0.3, rng.random() < 0.3
        if bad:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join([text.split()[0]] * 60)])
        if toxic:
            text += " you " + rng.choice(["grumblor", "grumbl0r", "GRUMBLОR", "zarnikblo", "zarnikmi"]) + " " + prose(rng, 5)
        rows.append((i, text))
        marks.append((i, int(not bad), int(toxic), 0.0))
    return rows, marks


def test_quality_on_held_out_rows(spark, documents, odd_rows):
    rows, marks = corpus()
    truth = {i: q for i, q, _, _ in marks}
    extra = [(i + 1000 if i else None, t) for i, t in odd_rows]
    noise = [(3, None, None, 0.0), (None, 1, 1, 0.0), (99_999, 0, 0, 0.0), marks[0], marks[1]]
    out = quality.classify_quality(documents(rows + extra), labels(spark, marks + noise)).collect()
    assert len(out) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id, 5) == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 1000]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_toxicity_on_held_out_rows(spark, documents, odd_rows):
    rows, marks = corpus()
    truth = {i: t for i, _, t, _ in marks}
    extra = [(i + 1000 if i else None, t) for i, t in odd_rows]
    out = toxicity.classify_toxicity(documents(rows + extra), labels(spark, marks)).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id, 4) == 2) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 1000]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert not any(r.predicted for r in out if r.doc_id is None or r.doc_id >= 1000)


def test_folding_and_exceptions():
    assert toxicity.folded("Ｍ0r0n МОRОN m@d") == " moron moron mad "
    m = toxicity.Matcher({" bad ": 3.0, " bad": 1.0, " worse": 2.0}, frozenset({"not bad"}))
    assert m.measures("so BAD, worsening; badly") == (6.0, 1.5, 3.0)
    assert m.measures("not bad") == (0.0, 0.0, 0.0) and m.measures("") == (0.0, 0.0, 0.0)
    assert toxicity.Matcher({}, frozenset()).measures("bad") == (0.0, 0.0, 0.0)


def test_held_out_labels_are_not_used(spark, documents):
    rows, marks = corpus(120)
    flipped = [(i, 1 - q if crc(i, 5) == 0 else q, 1 - t if crc(i, 4) == 2 else t, s) for i, q, t, s in marks]
    docs = documents(rows)
    for classify in (quality.classify_quality, toxicity.classify_toxicity):
        a, b = (sorted((r.doc_id, r.score) for r in classify(docs, labels(spark, m)).collect()) for m in (marks, flipped))
        assert a == b


def test_without_labels(spark, documents, odd_rows):
    none = labels(spark, [])
    assert {r.score for r in quality.classify_quality(documents(odd_rows), none).collect()} == {1.0}
    assert {r.score for r in toxicity.classify_toxicity(documents(odd_rows), none).collect()} == {0.0}
    assert quality.classify_quality(documents([]), none).count() == toxicity.classify_toxicity(documents([]), none).count() == 0


def test_sample_is_bounded_and_keyed(spark):
    many = labels(spark, [(i, i % 2, 0, 0.0) for i in range(4000)])
    draw = lambda df: {r.doc_id for r in common.sample_of_labels(df, "quality", 5, 0, 300, "q").collect()}
    one = draw(many)
    assert 150 < len(one) < 330 and one == draw(many.repartition(7)) and all(crc(i, 5) for i in one)


def test_rows_of_a_fit_are_bounded_too(spark, documents):
    """A labelled id of many rows gives the fit one text."""
    rows = [(i, f"text {i} {k}") for i in range(4) for k in range(300)] + [(9, None), (9, "t"), (10, None)]
    sample = spark.createDataFrame([(i, i % 2) for i in (0, 1, 2, 3, 9, 10)], "doc_id bigint, y int")
    got = [tuple(r) for r in common.labelled_texts(documents(rows), sample).collect()]
    assert sorted(r[0] for r in got) == [0, 1, 2, 3, 9, 10] and all(y == i % 2 for i, y, _ in got)
    again = [tuple(r) for r in common.labelled_texts(documents(rows[::-1]).repartition(5), sample).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)


def plain_toxicity(model, text):
    """The score by searching every word's beginnings, without an automaton."""
    words = toxicity.folded(text or "").split()
    weights = []
    for i, w in enumerate(words):
        entries = [e for e in (f" {w} ", *(f" {w[:n]}" for n in toxicity.PREFIX if n <= len(w))) if e in model["lexicon"]]
        before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
        if entries and not model["exceptions"] & {f"{before} {w}", f"{w} {after}"}:
            weights.append(model["lexicon"][max(entries, key=len)])
    total = sum(weights)
    x = np.array([np.log1p(total), np.log1p(100 * total / max(1, len(words))), max(weights, default=0.0) / 4, 1.0])
    return 1 / (1 + np.exp(-x @ model["w"]))


def test_toxicity_equals_the_plain_version(spark, documents, odd_rows):
    rows, marks = corpus()
    rng = random.Random(5)
    rows += [(2000 + i, f"{'q' * 200} GRUMBLOR {'r' * 300}   {prose(rng, 4)} zarnikblo") for i in range(12)]
    marks += [(2000 + i, 1, 0, 0.0) for i in range(12)]
    docs = documents(rows + [(i + 5000 if i else None, t) for i, t in odd_rows])
    model = toxicity.fit_toxicity(docs, labels(spark, marks))
    assert any(len(p) > 200 for p in model["exceptions"])  # long neighbours are whole
    for r in toxicity.score_toxicity(docs, model, ("doc_id", "text")).collect():
        assert abs(r.score - plain_toxicity(model, r.text)) < 1e-6


def test_quality_equals_the_plain_version(spark, documents, odd_rows):
    rows, marks = corpus(160)
    docs = documents(rows + [(i + 5000 if i else None, t) for i, t in odd_rows])
    model = quality.fit_quality(docs, labels(spark, marks))
    buckets = quality.Buckets()
    for r in quality.score_quality(docs, model, ("doc_id", "text")).collect():
        x = quality.pooled(quality.tokens_of(r.text or "", buckets), model["vectors"])[None, :].astype(float)
        assert abs(r.score - quality.probability(model["network"], x)[0]) < 1e-6


def test_folding_covers_other_scripts():
    table = {"ѕυскеr": "sucker", "𝐛𝖆𝒅": "bad", "Ⓑⓐⓓ": "bad", "ᴍᴏʀᴏɴ": "moron", "ＢＡＤ": "bad", "ʙᎪᎠ": "bad", "mօrօո": "moron", "ВАԀ": "bad",
             "é": "é", "ñandú": "ñandú", "größe": "größe"}
    for odd, plain in table.items():
        assert toxicity.folded(odd) == f" {plain} "


LETTERS = {"aa": "bcdaei", "bb": "mnoxyz", "cc": "ßüörst"}


def sentences(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_language(documents, odd_rows):
    rng = random.Random(9)
    rows = [(i, sentences(rng, lang, rng.randrange(3, 60)), lang) for i, lang in enumerate(list(LETTERS) * 40)]
    rows += [(500, sentences(rng, "aa", 9), None), (501, None, "aa"), (502, "123 ?! 45", "aa"), (503, "", "bb"), (None, "bcd aei", "aa")]
    out = {r.doc_id: r for r in language.identify_language(documents(rows)).collect()}
    assert len(out) == len(rows)
    assert all(out[i].lang_pred == lang for i, _, lang in rows if i is not None and i < 500)
    assert out[500].lang_pred == out[None].lang_pred == "aa"
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (501, 502, 503))
    assert all(0 <= r.score <= 1 and r.held_out == (i is not None and crc(i, 4) == 2) for i, r in out.items())
    held = [(i, t, "bb" if crc(i, 4) == 2 else lang) for i, t, lang in rows[:120]]  # languages of held-out rows are not used
    again = {r.doc_id: r.score for r in language.identify_language(documents(held)).collect()}
    assert all(again[i] == out[i].score for i in range(120))
    assert language.identify_language(documents([])).count() == 0
    assert {r.lang_pred for r in language.identify_language(documents([(i, t, None) for i, t in odd_rows])).collect()} == {"und"}


def test_letters_are_those_of_unicode(documents):
    rows = [(i, sentences(random.Random(i), lang, 30), lang) for i, lang in enumerate(list(LETTERS) * 8)]
    odd = ["½ ²", "Ⅷ ①", "١٢٣", "_ __", "😀", "ªa", "中", "ǅ"]
    out = {r.doc_id: r for r in language.identify_language(documents(rows + [(900 + i, t) for i, t in enumerate(odd)])).collect()}
    assert all((out[900 + i].lang_pred, out[900 + i].score) == ("und", 0.0) for i in range(5))
    assert all(out[900 + i].lang_pred != "und" for i in range(5, 8))


def test_every_language_is_learned_block_by_block(documents, monkeypatch):
    """More languages than a task holds: the same answers, none left out."""
    alphabet = "abcdefghijklmnopqrstuvwxyzßüöäéèçñ"
    rng = random.Random(3)
    rows, own = [], {}
    for k in range(17):
        own[f"l{k:02d}"] = "".join(rng.sample(alphabet, 5))
        for j in range(6):
            rows.append((k * 10 + j, " ".join("".join(rng.choice(own[f"l{k:02d}"]) for _ in range(6)) for _ in range(40)), f"l{k:02d}"))
    rows += [(500, None, None), (501, "12", "l00")]
    docs = documents(rows)
    whole = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_language(docs).collect()}
    assert {v[0] for v in whole.values()} == {*own, "und"}
    monkeypatch.setattr(language, "LANGUAGES", 4)
    parts = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_language(docs).collect()}
    assert parts.keys() == whole.keys()
    assert all(parts[i][0] == whole[i][0] and abs(parts[i][1] - whole[i][1]) < 1e-9 for i in whole)


def test_gram_vectors_do_not_depend_on_the_cache(monkeypatch):
    texts = [sentences(random.Random(i), "aa", 50) for i in range(8)]
    whole = [language.Profiler().profile(t) for t in texts]
    monkeypatch.setattr(language, "GRAMS_KEPT", 20)
    small = language.Profiler()
    assert all((small.profile(t) == w).all() for t, w in zip(texts, whole, strict=True))


def test_workers_hold_the_objects_of_one_operator():
    """What one operator keeps in a Python worker is gone as soon as another one works there."""
    from riskvq.llm import common, near_dup

    built = []

    def held(key):
        return common.per_process(key, 1, lambda: built.append(key) or key)

    assert [held("codec"), held("codec")] == ["codec"] * 2 and built == ["codec"]
    held("automaton")
    held("codec")
    assert built == ["codec", "automaton", "codec"]
    near_dup._make_features()
    held("codec")
    assert built[3:] == ["codec"]
    common.forget()
