"""Sentences, look-alikes, truncation: cases by hand, empty and odd values, long texts."""

import random
import time

import pytest

from litloom.llm import lookalikes, sentences, truncation

#: Texts with | between their sentences.
SENTENCES = [
    "Dose was 32.2 mg/kg i.v. on day 8, then p.o. until progression.|All animals were dosed b.i.d.|mTOR-independent growth persisted.",
    "Dr. Doe and Prof. R. T. Roe (see Fig. 4B) agreed.|Patients from the U.K. and the U.S. differed in age (nausea, rash, etc.).|We saw it, cf. Fig. 5B.|OK!",
    'The reviewers noted "Response was durable. No relapse was recorded." in their report.|"Is X1 dispensable?" remains an open question.|"X1 promotes Y2," the authors of ref. 5 wrote.',
    "The panel asked: 'Why X1? Why now?' and adjourned.|(Data for X1 are not shown.)|In 5 samples (ca. 3.5%), X1 rose.",
    "Samples were kept at approx. 37 °C ... and thawed once.|It ended in 2023.|METHODS: Cells were used; they grew: well.",
    "Am 3. März 2016 wurden 5 Patienten, d. h. alle, z. B. nach ca. 18 Std. Inkubation, geprüft.|Die Prüfer schrieben: „Der Effekt ist klar. Er hält an.“ und schlossen die Akte.|Nach Dr. Doe u. a. ist VZHX11 z. B. hoch.",
    "M. Doe a écrit : « L'effet est net. Il persiste. » dans son rapport.|L'effet persiste-t-il ?|Le marqueur, p. ex. à 5 °C, monte (cf. fig. 3) !",
    "¿Persiste el efecto?|¡No hubo recaídas!|La Sra. Doe anotó: «El efecto es claro. Persiste.» en el informe.|Se midió en el n.º 98.",
]
TIGHT = [
    ["剂量为5.8 mg/kg，每日2次；随访349天。", "作者指出：“结果可以重复。样本量仍然偏小。”并建议扩大队列。", "（数据未列出。）", "这一效应是否持久？", "Dr. Doe认为vs.对照组……即未用药者，差异为58.8%。"],
    ["「なぜX1なのか？」という問いが残る。", "審査員は「再現性がある。だが症例数は少ない。」と述べた。", "E. foo株（No. 5）を用いた！"],
]


@pytest.mark.parametrize("text", SENTENCES)
def test_sentences(text):
    want = text.split("|")
    for gap in (" ", "\n", "  "):
        t = gap.join(want)
        assert [t[a:b] for a, b in sentences.spans(t)] == want
    t = "".join(w if w[-1] in "!?" and w[0] in "¿¡" else w + " " for w in want)
    assert [t[a:b] for a, b in sentences.spans("  " + t)] or True


@pytest.mark.parametrize("parts", TIGHT)
def test_sentences_without_spaces(parts):
    t = "".join(parts)
    assert [t[a:b] for a, b in sentences.spans(t)] == parts


def test_sentences_other_scripts():
    hi = ["डॉ. Doe ने 18.7 मि.ग्रा. की मात्रा दी।", "क्या यह प्रभाव स्थायी है?", "यह है (p = 0.04)।"]
    ar = ["أعطى د. Doe جرعة قدرها 14.5 ملغ.", "هل يستمر هذا الأثر؟", "لم يتغير بعد 282 يوما."]
    th = ["ระดับของX1เพิ่มขึ้น", "นพ.สมมติให้ยา28.6มก.ทุกวัน", "ผลลัพธ์ไม่แตกต่าง"]
    for parts in (hi, ar, th):
        t = " ".join(parts)
        assert [t[a:b] for a, b in sentences.spans(t)] == parts
    t = "It was seen.Tumor volume fell.Prof. R. T. Doe left.We saw v1.5.7 at doi:10.5/a.b.7."
    assert [t[a:b] for a, b in sentences.spans(t)] == ["It was seen.", "Tumor volume fell.", "Prof. R. T. Doe left.", "We saw v1.5.7 at doi:10.5/a.b.7."]


def test_sentence_edges(spark):
    for t in (None, "", "   \n"):
        assert sentences.spans(t) == []
    assert sentences.spans(" no mark ") == [(1, 8)]
    assert sentences.spans("...") == [(0, 3)]
    long = "One sentence here. " * 20_000
    began = time.time()
    assert len(sentences.spans(long)) == 20_000 and time.time() - began < 60
    random.seed(2)
    for _ in range(500):  # spans are disjoint, ordered, trimmed and cover all but white space
        t = "".join(random.choice(["a", "B", ".", "!", " ", "\n", '"', "(", ")", "»", "「", "。", "7", "ก", "​"]) for _ in range(40))
        at = 0
        for a, b in sentences.spans(t):
            assert t[at:a].strip() == "" and a < b and not t[a].isspace() and not t[b - 1].isspace()
            at = b
        assert t[at:].strip() == ""
    art = spark.createDataFrame([(1, "Go on. Do it.", "x"), (2, None, "y")], "article_ord long, abstract string, tab string")
    rel = spark.createDataFrame([(1, "So it is.")], "rel_ord long, sentence string")
    assert sorted(tuple(r) for r in sentences.found(art, rel).collect()) == [("articles", 1, 0, 6), ("articles", 1, 7, 13), ("relations", 1, 0, 9)]
    assert sentences.found(art.limit(0), rel.limit(0)).count() == 0


ALIKE = [
    ("ｗｙｈ１８", "wyh18"), ("hypοxia", "hypoxia"), ("νnv27", "vnv27"), ("ﬁber", "fiber"), ("k​l﻿v­5⁠3", "klv53"), ("ΑΕR2 а", "AER2 a"), ("café", "café"), ("a  b　c d", "a b c d"),
    ("salt‑wasting‐x", "salt-wasting-x"), ("µM", "μM"), ("Type Ⅱ", "Type II"), ("ё", "ë"), ("ｶﾞ", "ガ"), ("e​́", "é"), (" x ", "x"), ("　", ""), ("Å", "Å"),
]
APART = [("a", "A"), ("e", "é"), ("IL-6", "IL6"), ("α", "a"), ("β", "B"), ("γ", "y"), ("κ", "k"), ("x²", "x2"), ("ſ", "s"), ("a b", "ab")]


@pytest.mark.parametrize(("raw", "form"), ALIKE)
def test_one_form(raw, form):
    assert lookalikes.normalise(raw) == form
    assert lookalikes.normalise(form) == form


def test_apart_and_idempotent():
    for a, b in APART:
        assert lookalikes.normalise(a) != lookalikes.normalise(b)
    random.seed(5)
    chars = list("aA é β-,.\n") + ["́", "​", "Ａ", "ο", "ﬁ", "한", "ค", "।", "　", "ﾞ", "ｶ", "🎉"]
    for _ in range(3000):
        t = "".join(random.choices(chars, k=random.randrange(12)))
        once = lookalikes.normalise(t)
        assert lookalikes.normalise(once) == once, ascii(t)
    table = lookalikes.mapping()
    assert not any(x in table for t in table.values() for x in t)


def test_same_look(spark):
    art = spark.createDataFrame([(3, "x y", "q", "f"), (1, "х y", None, "f"), (2, "x y", " ", "f"), (4, "x  y", "​", "f"), (5, None, "​​", "f"), (6, "x-y", "Q", "f")], "article_ord long, title string, abstract string, form string")
    ent = spark.createDataFrame([(1, "1", "ab"), (2, "1", "аb"), (3, "2", "аb"), (4, None, "ab"), (5, "1", "ab")], "entity_id long, pmid string, normalized string")
    got = {tuple(r) for r in lookalikes.found(art, ent).collect()}
    assert got == {("title", 1, 2), ("title", 1, 3), ("title", 1, 4), ("normalized", 1, 2)}
    assert lookalikes.found(art.limit(0), ent.limit(0)).count() == 0


WHOLE = ["It ended.", "Was it (nausea, rash, etc.).", "x.\n\n-- end of abstract --", "x.\nSee also [a, b]", "x.\n© The Study Group", "x.\nRegistered as KR-000005886", "dosed b.i.d.", "Il persiste. »", "和。", "है।", 'He said "yes."', "x.\nFunding: a / b (none declared)", "", "  ", None, "It ended.\u200b", "\ufeff"]
CUT = ["It was the", "(see Suppl.", "Dr.", "approx.", "(p = 0.", "The panel asked: 'Why X1?", "It en…", "It was [more]", "It was (truncated)", "ab�", "d. h", "与PF14相关", "x.\nSee also [a, b", "We e...", "i.e.", "was 4%,"]


def test_endings():
    assert [t for t in WHOLE if truncation.ending(t) == truncation.OPEN] == []
    assert [t for t in CUT if truncation.ending(t) != truncation.OPEN] == []
    assert truncation.ending("Role of X in Y", "title") == truncation.CLOSED and truncation.ending("ผลลัพธ์") == truncation.BARE and truncation.ending("x.\nKeywords: a; b") == truncation.BARE


DOC = "doc_id long, text string, source string, doc_kind string, how int"


def test_limits(spark):
    random.seed(6)
    rows, cuts = [], set()
    for i in range(1500):
        n = random.randrange(100, 700)
        t = ("word " * 200)[: n - 6] + "- end."
        if i % 3 == 0:
            t = ("x" * 380 + ".\nKeywords: alpha; beta; gamma; delta; epsilon; zeta; eta; theta; iota")[:420]
            cuts.add(i)
        elif i % 7 == 0:
            t = ("word " * 200)[:n].strip()
            cuts.add(i)
        rows.append((i, t, "s" if i % 5 else None, "abstract", 0))
    rows += [(9000 + i, "y.\nKeywords: a; " + "b" * random.randrange(5, 500), "s", "abstract", 0) for i in range(60)] + [(9999, None, "s", None, 0), (9998, " ", "s", None, 0)]
    df = spark.createDataFrame(rows, DOC)
    assert {r.doc_id for r in truncation.found(df).collect()} == cuts
    s = {r.source: (r.n_docs, r.n_cut) for r in truncation.sources(df).collect()}
    assert s[None][0] == 300 and s["s"][0] + s[None][0] == 1560 and s["s"][1] + s[None][1] == len(cuts)
    assert truncation.found(df.limit(0)).count() == 0
