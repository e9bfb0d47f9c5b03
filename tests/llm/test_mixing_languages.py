"""Mixtures meet their targets under the caps; languages are found on held-out texts and in segments."""

import random

from matrica.llm.languages import document_languages, fit_languages, language_of, language_segments, sentences
from matrica.llm.mixing import Target, mix_sources, mixture_shares

WORDS = {
    "en": "the device measures pressure with several valves and channels which are heated during operation of this machine",
    "de": "die vorrichtung misst den druck mit mehreren ventilen und kanälen welche während des betriebs erhitzt werden",
    "es": "el dispositivo mide la presión con varias válvulas y canales que se calientan durante el funcionamiento de esta máquina",
    "ru": "устройство измеряет давление при помощи нескольких клапанов и каналов которые нагреваются во время работы этой машины",
    "zh": "所述装置测量压力并具有多个阀门和通道在运行期间被加热从而减少磨损",
}


def sentence(rng, lang, n=12):
    if lang == "zh":
        return "".join(rng.choice(WORDS["zh"]) for _ in range(2 * n)) + "。"
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n)).capitalize() + "."


def text(rng, *parts):
    return " ".join(sentence(rng, lang) for lang, n in parts for _ in range(n))


def test_languages_and_segments(spark):
    rng = random.Random(4)
    data = [(i, text(rng, (lang, rng.randint(3, 8))), lang if rng.random() > 0.15 else rng.choice(list(WORDS))) for i, lang in enumerate(list(WORDS) * 30)]
    truth = {i: list(WORDS)[i % 5] for i, _, _ in data}
    mixed = [
        (1000, text(rng, ("en", 5), ("de", 3), ("en", 4)), "en"), (1001, text(rng, ("es", 5), ("ru", 1), ("es", 4)), None), (1002, "", "en"), (1003, None, "en"), (1004, "12 34 = x", "en"),
        (1005, "TITLE\n" + text(rng, ("zh", 4)) + "\n\nCLAIMS\n1. " + sentence(rng, "en") + "\n2. " + sentence(rng, "en"), "zh"), (1006, text(rng, ("en", 3000)), "??"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in data + mixed], "doc_id bigint, text string, lang string, confidence string")
    model = fit_languages(df, "text", "lang", key="doc_id")
    segments = language_segments(df, "doc_id", "text", model)
    got = {}
    for r in segments.orderBy("doc_id", "segment").collect():
        got.setdefault(r["doc_id"], []).append((r["lang"], r["n_sentences"]))
        assert 0 < r["confidence"] <= 1
    main = {r["doc_id"]: r["lang"] for r in document_languages(segments, "doc_id").collect()}
    assert sum(main[i] == lang for i, lang in truth.items()) >= 0.98 * len(truth)
    assert got[1000] == [("en", 5), ("de", 3), ("en", 4)] and got[1006] == [("en", 3000)]
    assert ("ru", 1) in got[1001] or got[1001] == [("es", 10)]
    assert 1002 not in got and 1003 not in got and [lang for lang, n in got[1005] if n >= 2] == ["zh", "en"]
    assert language_segments(df.limit(0), "doc_id", "text", model).count() == 0


def test_labels(spark):
    labels = {"en": "en", "EN-gb": "en", "deu": "de", "zh_CN": "zh", "French": "fr", " es ": "es", "und": None, "??": None, "": None, None: None, "n/a": None, "english text": None}
    df = spark.createDataFrame([(k, v) for k, v in labels.items()], "lang string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", language_of("lang")).collect())


def test_wrapped_lines_are_joined():
    assert sentences("HEAD\nOne line that was wrapped here because it is long, so it\ngoes on. Next one.\n\nLast") == ["HEAD", "One line that was wrapped here because it is long, so it goes on.", "Next one.", "Last"]


def documents(spark, rng):
    sizes = {"big": 400, "mid": 120, "small": 12}
    data, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            data.append((i, text(rng, (rng.choice(["en", "de"]), rng.randint(1, 12))), source, 1))
            i += 1
    data += [(i, "no source at all here.", None, 1), (i + 1, "", "big", 1), (i + 2, None, "mid", 1), (i + 3, data[0][1], "big", 1), (i + 4, "other words.", "unlisted", 1)]
    return spark.createDataFrame(data, "doc_id bigint, text string, source string, copies int")


def test_mixture_meets_targets_and_caps(spark):
    df = documents(spark, random.Random(3))
    targets = [Target("big", 0.5, 1), Target("mid", 0.38, 2), Target("small", 0.12, 5), Target("absent", 0.0, 3)]
    mixture = mix_sources(df, "doc_id", "text", "source", targets).cache()
    caps = {t.source: t.max_repeats for t in targets}
    rows = mixture.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(1 <= r["copies"] <= caps[r["source"]] and r["n_tokens"] > 0 for r in rows)
    shares = {r["source"]: r for r in mixture_shares(mixture, spark.createDataFrame([(t.source, t.share) for t in targets], "source string, target_share double")).collect()}
    largest = max(r["n_tokens"] for r in rows) / sum(r["n_tokens"] * r["copies"] for r in rows)
    assert all(abs(shares[t.source]["actual_share"] - t.share) <= 2 * largest for t in targets) and shares["absent"]["tokens"] == 0
    half = mix_sources(df, "doc_id", "text", "source", targets, size=sum(r["n_tokens"] * r["copies"] for r in rows) // 2)
    assert abs(sum(r["n_tokens"] * r["copies"] for r in half.collect()) * 2 / sum(r["n_tokens"] * r["copies"] for r in rows) - 1) < 0.05


def test_empty_mixtures(spark):
    df = documents(spark, random.Random(3)).limit(0)
    assert mix_sources(df, "doc_id", "text", "source", [Target("big", 1.0, 1)]).count() == 0
    assert mix_sources(documents(spark, random.Random(3)), "doc_id", "text", "source", []).count() == 0
