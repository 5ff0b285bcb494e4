"""Languages of documents and foreign lines: held-out accuracy on made texts, and defined results for odd ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.llm import language as L

WORDS = {
    "en": "the pump is connected to a valve and moves within range of device when it turns which protects against early wear this can be made from wood".split(),
    "de": "die pumpe ist mit dem ventil verbunden und bewegt sich in einem bereich wenn sie dreht wodurch der verschleiß verhindert wird auch aus holz".split(),
    "fr": "la pompe est reliée à une soupape et se déplace dans plage du dispositif quand elle tourne ce qui protège contre usure peut être faite en bois".split(),
    "es": "la bomba está conectada con una válvula y se mueve en intervalo del dispositivo cuando gira lo que protege contra desgaste puede hacerse de madera".split(),
    "nl": "de pomp is verbonden met het ventiel en beweegt binnen een bereik wanneer zij draait waardoor slijtage wordt voorkomen kan ook van hout gemaakt".split(),
}
WIDE = {"zh": "泵与阀门相连接并在范围内移动，如果压力超过则打开并使其卸压，这种方案制造成本低。", "ja": "ポンプは弁に接続され、範囲内で移動する。もちろん木から作ることもできる。", "ru": "Насос соединён с клапаном и перемещается в пределах, если давление превышает норму. "}


def sentence(code, n=14):
    if code in WIDE:
        return WIDE[code] * 2
    return " ".join(random.choice(WORDS[code]) for _ in range(n)).capitalize() + "."


def corpus(n=200):
    random.seed(5)
    out, truth = [], set()
    for i in range(n):
        code = random.choice([*WORDS, *WIDE])
        lines = [sentence(code) for _ in range(6)]
        if i % 4 == 0:
            other = random.choice([c for c in [*WORDS, *WIDE] if c != code])
            lines.insert(3, "  " + sentence(other) + "\r")
            lines.insert(1, "")
            truth.add((i, 4, other))
        if i % 5 == 0:
            lines.insert(2, "F = d · P48 / (72 π T + 0,33 … (Eq. 84)")
            truth = {(d, p + (d == i), c) for d, p, c in truth}
        label = code
        if i % 10 == 3:
            label = random.choice([None, " ", "und", "xx", "it", next(c for c in WORDS if c != code)])
            truth.add((i, 0, code))
        elif i % 10 == 4:
            label = {"en": "en-US", "de": "German", "fr": "FRA", "es": "spa", "nl": "dut", "zh": "zh-Hans", "ja": "jpn", "ru": "Russian"}[code]
        out.append((i, "\n".join(lines), label, "web", f"{code[0].upper()}X{i}", f"host {i % 7}", 1.0))
    return out, truth


SCHEMA = "doc_id long, text string, lang string, source string, pub_no string, applicant string, evidence double"


def test_cases_are_found(spark):
    data, truth = corpus()
    odd = [(900, None, "en"), (901, "", "en"), (902, " \n\t\n", None), (903, "12 + 34 = 46", "en"), (904, sentence("de", 60000), "de"), (900, None, "en")]
    data += [(i, t, g, None, None, None, None) for i, t, g in odd]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.doc_id, r.para_no, r.lang) for r in L.language_cases(df).collect()}
    real = {x for x in got if x[0] < 900}
    assert not {x[0] for x in got} & {900, 901, 902, 904}
    assert len(real & truth) / len(truth) > 0.98 and len(real & truth) / len(real) > 0.98, (real - truth, truth - real)
    docs = L.document_languages(df).collect()
    assert all(0 < r.confidence < 1 for r in docs) and len(docs) == len(data) - 4
    lines = [x.confidence for r in docs for x in r.segments if x.lang != r.lang]
    assert lines and all(0 < x < 1 for x in lines)
    assert L.language_cases(df.limit(0)).collect() == []


def test_evidence_decides_where_text_does_not(spark):
    data, _ = corpus(120)
    data += [(700, "4711 / 0815", None, "web", "DX700", "host 1", None)]
    df = spark.createDataFrame(data, SCHEMA)
    assert {r.lang for r in L.document_languages(df).where("doc_id = 700").collect()} == {"de"}


def test_held_out_lines():
    random.seed(6)
    codes = [random.choice([*WORDS, *WIDE]) for _ in range(300)]
    texts = [sentence(c) for c in codes]
    table = L.fit(texts[:150], [c if random.random() > 0.1 else "pt" for c in codes[:150]])
    evidence, _ = L.read_texts(L.Reader(table), texts[150:])
    assert np.mean([L.LANGS[i] == c for i, c in zip(evidence.argmax(axis=1), codes[150:], strict=True)]) > 0.98


def test_confidence_is_tempered_on_held_out_lines():
    random.seed(7)
    codes = [random.choice(["en", "de", "nl", "fr", "es"]) for _ in range(600)]
    model = L.fit([sentence(c) for c in codes[:400]], codes[:400])
    assert model.doubt == 1 / 102
    # One or two words, of which many languages have some: wrong readings must not look certain.
    texts = [" ".join(random.choice(WORDS[c]) for _ in range(random.randint(1, 2))) for c in codes[400:]]
    evidence, _ = L.read_texts(L.Reader(model), texts)
    p = np.exp(L._log_softmax(evidence))
    right = np.array([L.LANGS[i] == c for i, c in zip(p.argmax(axis=1), codes[400:], strict=True)])
    top = p.max(axis=1)
    assert 0.5 < right.mean() < 1 and top.min() < 0.8 and abs(top.mean() - right.mean()) < 0.15
    assert top[right].mean() > top[~right].mean()


def test_priors_decide_short_texts(spark):
    data, _ = corpus(160)
    # "in" and "is" are words of more than one language.
    data += [(800 + i, text, label, "web", f"{c}X", None, None) for i, (text, label, c) in enumerate([("in", "de", "D"), ("in", "en", "E"), ("is", "nl", "N"), ("is", "en", "E")])]
    got = {r.doc_id: r.lang for r in L.document_languages(spark.createDataFrame(data, SCHEMA)).where("doc_id >= 800").collect()}
    assert got == {800: "de", 801: "en", 802: "nl", 803: "en"}


def test_formula_behind_a_wide_line(spark):
    page = L.read_page(["泵与阀门相连接并在范围内移动 F = d · 48 / 72 + 0,33 (84)", "F = d · P48 / (72 T + 0,33 … (Eq. 84)"])
    _, letters = L.Reader(L.fit([], [])).lines(page)
    assert L._wordy(page, letters).tolist() == [True, False]


def test_seed_words_alone_know_the_languages():
    reader = L.Reader(L.fit([], []))
    for code in ("en", "de", "fr", "nl", "ru", "zh", "ja"):
        evidence, _ = L.read_texts(reader, [sentence(code, 40) if code in {**WORDS, **WIDE} else ""])
        assert L.LANGS[evidence[0].argmax()] == code


@pytest.mark.parametrize(("label", "code"), [("EN", "en"), ("en_GB", "en"), (" deu ", "de"), ("zh-Hans", "zh"), ("Japanese", "ja"), ("und", None), ("", None), (None, None), ("n/a", None), ("sv", None)])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "x string").select(L.label_code(F.col("x"))).first()[0] == code
