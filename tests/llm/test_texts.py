import random

import numpy as np
import pytest

from statuta.llm import pairs, scans, sentences

ANSWERS = {
    "en": "The {a} must keep the {b} at the office when a user of the system has a claim.",
    "de": "Die {a} müssen den {b} bei der Behörde und nach dem Antrag der Kunden aufbewahren.",
    "fr": "Les {a} doivent conserver le {b} dans les bureaux de la ville pour une durée fixe.",
    "es": "Los {a} deben guardar el {b} en la oficina de la ciudad para que no se pierda.",
}
QUESTIONS = {
    "en": "When must the {a} keep the {b} of the system at the office {n}?",
    "de": "Wann müssen die {a} den {b} bei der Behörde und nicht im Amt aufbewahren {n}?",
    "fr": "Quand les {a} doivent-ils conserver le {b} dans les bureaux de la ville {n} ?",
    "es": "¿Cuándo deben los {a} guardar el {b} en la oficina de la ciudad {n}?",
}


def logged(rnd, n):
    out = []
    for i in range(n):
        k = rnd.choice(list(ANSWERS))
        a, b = (rnd.choice(["planum", "registra", "testora", "normata", "belgara", "sundoka"]) for _ in range(2))
        out.append((QUESTIONS[k].format(a=a, b=b, n=i), " ".join(ANSWERS[k].format(a=b, b=rnd.choice([a, b, "modula"])) for _ in range(rnd.randrange(1, 4))) + (f"\n- {a}\n- the {b}" if i % 9 == 0 else "")))
    return out


@pytest.fixture(scope="module")
def model():
    c = pairs.Classifier()
    rows = logged(random.Random(1), 1500)
    c.language.train([x for r in rows for x in r])
    return c.train(pairs.examples(rows, c.language))


def test_made_defects_are_found_on_other_pairs(model):
    ex = pairs.examples(logged(random.Random(2), 600), model.language, seed=99)
    right = 0
    for f, y in ex:
        over = model.chances(model.score(list(set(f))))
        k = int(over.argmax())
        right += (k if over[k] > 0 else -1) == y
    assert right / len(ex) > 0.97


Q = "When must the planum keep the registra of the system at the office 5?"


@pytest.mark.parametrize(
    "answer, defect",
    [
        (None, "empty"), ("", "empty"), (" \n", "empty"), ("—", "empty"), ("null", "empty"), ("​", "empty"),
        (Q, "copied"), (Q.upper(), "copied"), ("You asked: " + Q, "copied"), (Q + " " + Q, "copied"),
        ("I'm sorry, but I can't help with that request.", "refusal"), ("The sources do not contain enough information to answer.", "refusal"),
        ("The testora must keep the modula at the office when a user of the sys", "truncated"), ("The testora must keep the modula at the office (", "truncated"),
        (ANSWERS["fr"].format(a="testora", b="modula"), "other_language"),
        (ANSWERS["en"].format(a="testora", b="modula"), None),
        (ANSWERS["en"].format(a="testora", b="modula") + " The passages do not contain sufficient information on the data sheet.", None),
        ("The question is: " + Q + " " + ANSWERS["en"].format(a="testora", b="modula"), None),
        (ANSWERS["en"].format(a="testora", b="modula") + "\n- the data sheet\n- the audit plan", None),
    ],
)
def test_defects(model, answer, defect):
    assert model.defect(Q, answer) == defect


def test_pairs_with_nulls(spark, model):
    df = spark.createDataFrame([(1, None, None, "x"), (2, Q, "", "x"), (2, Q, "", "x"), (3, None, ANSWERS["en"].format(a="testora", b="modula"), "x")], "response_id long, query string, answer string, defect string")
    got = sorted((r["response_id"], r["defect"]) for r in pairs.defects(df, model=model).collect())
    assert got[:3] == [(1, "empty"), (2, "empty"), (2, "empty")]
    assert pairs.defects(df.limit(0), model=model).count() == 0


P = "source_file string, page_number int, text string, parent_document string"
COMMON = "The market office must keep the data sheet while the system is in use.\nThe board must review the audit plan and the technical dossier.\nA machine-readable form and a machine-readable file are kept.\nThe board shall sign pre- and post-market checks.\nThe authority must inform the committee without delay."


def book(spark):
    pages = []
    for i in range(1, 9):
        ls = COMMON.split("\n")
        body = "\n".join(ls[i % 5 :] + ls[: i % 5])
        if i == 3:
            body = "The b0ard must revievv the audit plan.\nThe market of­fice must keep the tech-\nnical dossier in a machine-\nreadable form. The cornmittee signs pre-\nand post-market checks and the autho-"
        if i == 4:
            body = "rity must inform.\n(2)\n" + COMMON
        head = f"Gazette, series C, 3.{i % 3 + 1}.2031"
        title = "Act (NU) 2031/7 — Checks\n\n" if i == 1 else ""
        pages.append(("a.pdf", i, f"{head}\n\n{title}{body}\n\n- {i + 40} -", "Act (NU) 2031/7"))
    return spark.createDataFrame(pages + [pages[2], ("a.pdf", 9, None, None), ("a.pdf", 10, "  \n ", None), ("b.pdf", 1, COMMON, None)], P)


def test_damage_of_a_book(spark):
    got = [tuple(r) for r in scans.damage(book(spark)).collect()]
    assert {k[1]: k[2] for k in got if k[3] == "running_header"} == {i: 1 for i in range(1, 9)}
    assert {k[1] for k in got if k[3] == "page_number"} == set(range(1, 9))
    words = {(k[2], k[4]) for k in got if k[1] == 3 and k[3] in ("broken_word", "wrong_characters")}
    assert {(3, "board"), (3, "review"), (4, "technical"), (5, "machine-readable"), (6, "committee"), (7, "authority")} <= words
    assert not any(v.startswith("pre") for _, v in words)


def test_paragraphs_of_a_book(spark):
    rows = scans.paragraphs(book(spark)).orderBy("source_file", "paragraph").collect()
    text = "\n".join(r["text"] for r in rows)
    assert "The board must review the audit plan." in text and "the authority must inform." in text
    assert "keep the technical dossier in a machine-readable form." in text and "Gazette" not in text and "- 43 -" not in text
    assert [r["paragraph"] for r in rows if r["source_file"] == "a.pdf"] == list(range(1, len(rows)))


def test_no_pages(spark):
    e = spark.createDataFrame([], P)
    assert scans.damage(e).count() == 0 and scans.paragraphs(e).count() == 0


def corpus(rnd):
    """Paragraphs with abbreviations, numbers and quotations, and what they look like at a paragraph's end."""
    subjects = ["The board", "Dr. Smith", "The office of N.U. Council", "Prof. Jones", "Alpha Ltd.", "The chair"]
    ends = ["the plan", "Annex V", "Article 12", "the list", "3 p.m.", "the logs, etc.", "Beta Ltd."]
    out = []
    for _ in range(600):
        ss = []
        for _ in range(rnd.randrange(1, 5)):
            e = rnd.choice(ends)
            s = f"{rnd.choice(subjects)} signed No. {rnd.randrange(1, 90)} of {e}"
            ss.append(s if s.endswith(".") else s + ".")
        ss.append(rnd.choice(["Who may see it?", "He said: “We saw it. Nothing is lost.”", "It fell from 1.5 % to 0.5 %, e.g. in May."]))
        rnd.shuffle(ss)
        out.append(" ".join(ss))
    return ["\n\n".join(out[i : i + 4]) for i in range(0, len(out), 4)]


@pytest.fixture(scope="module")
def tagger():
    docs = corpus(random.Random(3))
    thai = ["ผู้ตรวจสอบต้องส่งรายงาน มาตรา 5 กำหนดให้เก็บเอกสาร\n\nโรงเรียนต้องเก็บเอกสาร\n\nผู้ตรวจสอบต้องส่งรายงาน"] * 20
    ja = ["検査官は「記録を見た。問題はない。」と述べた。学校は記録を保存する。\n\n病院は記録を保存する。"] * 20
    return sentences.Tagger().train(sentences.weak_labels([c for i, t in enumerate(docs + thai + ja) for c in sentences.examples(t, i)]))


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []), ("", []), (" \n\n ", []),
        ("Article 4\n\nThe board signed. Who may see it?", ["Article 4", "The board signed.", "Who may see it?"]),
        ("Dr. Smith signed No. 7 of Annex V. The chair left at 3 p.m. Prof. Jones stayed.", ["Dr. Smith signed No. 7 of Annex V.", "The chair left at 3 p.m.", "Prof. Jones stayed."]),
        ("It fell to 0.5 %, e.g. in May. He said: “We saw it. Nothing is lost.” The board signed.", ["It fell to 0.5 %, e.g. in May.", "He said: “We saw it. Nothing is lost.”", "The board signed."]),
        ("The board\nsigned the plan.", ["The board\nsigned the plan."]),
        ("(See the list. It is long.) The board signed.", ["(See the list. It is long.)", "The board signed."]),
        ("検査官は「記録を見た。問題はない。」と述べた。病院は記録を保存する。", ["検査官は「記録を見た。問題はない。」と述べた。", "病院は記録を保存する。"]),
        ("โรงเรียนต้องเก็บเอกสาร มาตรา 5 กำหนดให้เก็บเอกสาร ผู้ตรวจสอบต้องส่งรายงาน", ["โรงเรียนต้องเก็บเอกสาร", "มาตรา 5 กำหนดให้เก็บเอกสาร", "ผู้ตรวจสอบต้องส่งรายงาน"]),
        ("1. The board signed. Alpha Ltd. signed No. 3 of the list.", ["1. The board signed.", "Alpha Ltd. signed No. 3 of the list."]),
    ],
)
def test_sentences(tagger, text, want):
    got = sentences.spans(text, tagger)
    assert [text[a:b] for a, b in got] == want


def test_every_character_is_in_one_sentence(spark, tagger):
    docs = corpus(random.Random(8))[:20] + ["x" * 50_000, "no end (", "“open quotation. Never closed. Still the end."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)] + [(99, None, "x"), (98, "", "x")], "doc_id long, text string, start_pos string")
    rows = sentences.sentences(df, tagger=tagger).collect()
    for i, t in enumerate(docs):
        mine = sorted((r["start_pos"], r["end_pos"]) for r in rows if r["doc_id"] == i)
        assert "".join("".join(t[a:b].split()) for a, b in mine) == "".join(t.split())
        assert all(t[a:b] == t[a:b].strip() for a, b in mine)
    assert not any(r["doc_id"] > 90 for r in rows)


def test_marks_never_closed_cost_no_more_than_others():
    for p in ("(" * 50_000, "“" * 20_000 + "a”", "(a) " * 20_000 + "("):
        assert len(sentences.depths(p)) == (20_000 if p[1] == "a" else p.count("”"))
    assert sentences.depths("( “a” (b “c”") == [(2, 5), (9, 12)]
    assert sentences.depths("((a) “b” [c)") == [(0, 12)]


def test_stripped_texts_keep_the_places_of_their_ends():
    text, ends = sentences.stripped("ab cd. ef 3.5 gh?\n\nij kl")
    assert text == "ab cd ef 3.5 gh ij kl" and {5, 15, 21} <= ends and 10 not in ends


def test_scores_are_calibrated():
    rnd = np.random.default_rng(3)
    scores = rnd.normal(size=4000) * 3
    so = rnd.random(4000) < 1 / (1 + np.exp(-(0.5 * scores - 1)))
    slope, base = pairs.calibrated(scores, so)
    assert abs(slope - 0.5) < 0.08 and abs(base + 1) < 0.2
    # kinds parted cleanly, and only one kind
    slope, base = pairs.calibrated(np.array([-5.0, -4.0, 6.0, 7.0]), np.array([False, False, True, True]))
    assert np.isfinite([slope, base]).all() and slope * -4 + base < 0 < slope * 6 + base
    assert pairs.calibrated(np.zeros(3), np.zeros(3, bool)) == (1.0, 0.0)
