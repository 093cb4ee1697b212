"""Problem 2: question and answer pairs whose answer is empty, truncated, refused, copied or in another language."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.runtime import widen

DEFECTS = ("empty", "truncated", "refusal", "copied", "other_language")
#: Logged pairs from which at most the training examples are made, drawn by hash, and passes over the examples.
TRAIN_PAIRS = 6000
EPOCHS = 6
BITS = 18
LANGUAGE_BITS = 15
#: Words whose scores a worker remembers.
REMEMBERED = 200_000
#: Words from which on an answer's n-grams weigh less, so that together they weigh as those of so many words.
FULL_WEIGHT = 40
#: Frequent function words by which texts of each language are first told apart.
FUNCTION_WORDS = {
    "en": "the of to and in is for must shall may not when on a an by with as be has have or are this that under before during at from which",
    "de": "der die das und nicht müssen sollen dürfen bei den dem des ein eine einer nach vor zum zur ist im mit auf ohne auch ob dies unter gilt kann",
    "fr": "le la les des du et ne pas doivent peuvent dans de à par en au aux un une pour sur que qui est sans après avant afin sous je",
    "es": "el la los las del y no deben pueden en de a por para con un una que se es sin después antes bajo según conforme lo qué este",
    "it": "il lo la i gli le dei degli e non devono possono dovrebbero in di a per con un una che si è senza dopo prima come alla su questa",
}
#: Strings that stand for no answer.
PLACEHOLDERS = ("", " ", "\n", "​", " ", "\t \n", "-", "—", "--", "...", "…", ".", "[]", "{}", "()", '""', "''", "null", "NULL", "None", "none", "nil", "n/a", "N/A", "n/a.", "N.A.", "NaN", "nan", "undefined", "<empty>", "[no answer]", "?", "*", "_")
#: How an echoed question is announced, by language.
ANNOUNCED = {
    "en": ("The question is: ", "You asked: ", "Question: ", "Your question: ", "You want to know: ", "Asked: ", "Q: ", "Query: ", "The user asks: "),
    "de": ("Die Frage lautet: ", "Sie fragten: ", "Frage: ", "Ihre Frage: "),
    "fr": ("La question est : ", "Vous demandez : ", "Question : ", "Votre question : "),
    "es": ("La pregunta es: ", "Usted pregunta: ", "Pregunta: ", "Su pregunta: "),
    "it": ("La domanda è: ", "Lei chiede: ", "Domanda: ", "La sua domanda: "),
}
#: Parts of the refusals that are made up for training: beginnings, whole refusals, ends.
REFUSALS = {
    "en": (
        ("", "Hello. ", "Sorry, ", "I'm sorry, but ", "Unfortunately, ", "My apologies, ", "Regrettably, ", "As an assistant, ", "Sorry — ", "\n", "Thank you for asking. "),
        (
            "I can't help with that request.", "I cannot help with this.", "I am unable to answer this question.", "I am unable to answer this based on the passages.", "I'm not able to respond to this.",
            "there is not enough information here for me to respond.", "there is not enough information to answer this.", "the sources do not contain enough information to answer.",
            "the provided context does not contain sufficient information to answer this question.", "the passages do not contain sufficient information to answer the question.",
            "the passages say nothing about this, so no answer can be given.", "nothing in the retrieved passages lets me reply.", "nothing in the sources allows me to answer.",
            "no answer is possible from the material retrieved.", "no answer can be given.", "that falls outside what I can discuss.", "this is outside what I can talk about.",
            "I would rather not speculate on this.", "I prefer not to comment on this.", "I must decline to comment on this matter.", "I have to decline to answer.", "this is something I will not comment on.",
            "I cannot provide legal assessments of this kind.", "I cannot give legal advice.", "I can't answer that.", "I won't be able to assist with this.", "I do not know the answer to this.",
        ),
        ("", "", " Please consult a qualified adviser.", " You may want to rephrase the question.", " Please ask something else.", " Please contact a lawyer."),
    ),
    "de": (
        ("", "Leider ", "Entschuldigung, ", "Es tut mir leid, "),
        (
            "kann ich dazu keine Auskunft geben.", "kann ich diese Frage nicht beantworten.", "ich kann dabei nicht helfen.", "dazu möchte ich mich nicht äußern.", "die Quellen enthalten nicht genügend Informationen, um zu antworten.",
            "der Kontext enthält nicht genügend Informationen, um die Frage zu beantworten.", "aus den Textstellen lässt sich keine Antwort ableiten.", "ich kann diese Anfrage nicht beantworten.", "darüber möchte ich nicht spekulieren.", "das kann ich nicht beurteilen.", "dazu liegen keine Informationen vor.",
        ),
        ("", "", " Bitte wenden Sie sich an eine Fachperson.", " Bitte formulieren Sie die Frage anders."),
    ),
    "fr": (
        ("", "Désolé, ", "Malheureusement, ", "Je suis désolé, mais "),
        (
            "je ne peux pas répondre à cette demande.", "je ne peux pas répondre à cette question.", "je préfère ne pas me prononcer.", "je ne suis pas en mesure de répondre.", "les sources ne contiennent pas assez d’informations pour répondre.",
            "le contexte ne contient pas assez d’informations pour répondre à la question.", "aucune réponse n’est possible à partir des passages.", "je ne peux pas vous aider.", "je ne souhaite pas commenter ce sujet.", "les passages ne disent rien à ce sujet.",
        ),
        ("", "", " Veuillez consulter un conseiller qualifié.", " Veuillez reformuler la question."),
    ),
    "es": (
        ("", "Lo siento, ", "Lamentablemente, ", "Perdone, "),
        (
            "no puedo ayudar con esta consulta.", "no puedo responder a esta pregunta.", "prefiero no pronunciarme sobre esto.", "no me es posible contestar.", "las fuentes no contienen información suficiente para responder.",
            "el contexto no contiene información suficiente para responder a la pregunta.", "no es posible dar una respuesta con los pasajes.", "no puedo comentar este asunto.", "los pasajes no dicen nada al respecto.",
        ),
        ("", "", " Consulte a un asesor cualificado.", " Reformule la pregunta."),
    ),
    "it": (
        ("", "Mi dispiace, ", "Purtroppo ", "Spiacente, "),
        (
            "non posso rispondere a questa richiesta.", "non posso rispondere a questa domanda.", "preferisco non esprimermi su questo.", "non sono in grado di rispondere.", "le fonti non contengono informazioni sufficienti per rispondere.",
            "il contesto non contiene informazioni sufficienti per rispondere alla domanda.", "nessuna risposta è possibile in base ai passaggi.", "non posso aiutare con questa richiesta.", "i passaggi non dicono nulla in proposito.",
        ),
        ("", "", " Si rivolga a un consulente qualificato.", " Riformuli la domanda."),
    ),
}
#: Sentences around the long refusals that are made up for training, before and after what they decline.
AROUND = {
    "en": (
        ("Thank you for your detailed question about the rules that apply here.", "This is a topic that many operators and authorities ask about.", "I understand that a clear reply would be useful to you and your colleagues.", "You ask how the act treats the case that you describe."),
        ("A lawyer who knows your situation can look at the facts and advise you.", "The competent authority of your country also publishes guidance that may be of use.", "It may help to read the act itself together with its annexes and recitals.", "If you have other questions about the documents, feel free to ask them at any time.", "Please keep in mind that rules may change and that deadlines may apply."),
    ),
    "de": (
        ("Vielen Dank für Ihre ausführliche Frage zu den hier geltenden Regeln.", "Dieses Thema beschäftigt viele Betreiber und Behörden.", "Ich verstehe, dass eine klare Auskunft für Sie nützlich wäre.", "Sie fragen, wie der Rechtsakt den beschriebenen Fall behandelt."),
        ("Eine Anwältin, die Ihre Lage kennt, kann den Sachverhalt prüfen und Sie beraten.", "Auch die zuständige Behörde Ihres Landes veröffentlicht Leitlinien, die nützlich sein können.", "Es kann helfen, den Rechtsakt selbst mit seinen Anhängen zu lesen.", "Wenn Sie weitere Fragen zu den Dokumenten haben, stellen Sie sie gern jederzeit."),
    ),
    "fr": (
        ("Merci pour votre question détaillée sur les règles applicables.", "Ce sujet intéresse de nombreux opérateurs et autorités.", "Je comprends qu’une réponse claire vous serait utile.", "Vous demandez comment l’acte traite le cas que vous décrivez."),
        ("Un avocat qui connaît votre situation peut examiner les faits et vous conseiller.", "L’autorité compétente de votre pays publie aussi des orientations qui peuvent être utiles.", "Il peut être utile de lire l’acte lui-même avec ses annexes.", "Si vous avez d’autres questions sur les documents, posez-les à tout moment."),
    ),
    "es": (
        ("Gracias por su pregunta detallada sobre las normas aplicables.", "Este tema interesa a muchos operadores y autoridades.", "Entiendo que una respuesta clara le sería útil.", "Usted pregunta cómo trata el acto el caso que describe."),
        ("Un abogado que conozca su situación puede examinar los hechos y asesorarle.", "La autoridad competente de su país también publica orientaciones que pueden ser útiles.", "Puede ser útil leer el propio acto junto con sus anexos.", "Si tiene otras preguntas sobre los documentos, puede hacerlas en cualquier momento."),
    ),
    "it": (
        ("Grazie per la sua domanda dettagliata sulle norme applicabili.", "Questo tema interessa molti operatori e autorità.", "Capisco che una risposta chiara le sarebbe utile.", "Lei chiede come l’atto tratta il caso che descrive."),
        ("Un avvocato che conosce la sua situazione può esaminare i fatti e consigliarla.", "Anche l’autorità competente del suo paese pubblica orientamenti che possono essere utili.", "Può essere utile leggere l’atto stesso con i suoi allegati.", "Se ha altre domande sui documenti, può farle in qualsiasi momento."),
    ),
}
#: What an answer may add about the limits of its sources without being a refusal; {0} is a phrase of the corpus.
LIMITS = ("The passages do not contain sufficient information on {0}.", "The sources say nothing about {0}.", "There is not enough information on {0} in the passages.", "Inspectors cannot help themselves to {0}; an authority may refuse or decline an application.")

WORDS = re.compile(r"[^\W_]+")
QUOTED = re.compile(r"“[^”]*”|„[^“]*“|«[^»]*»|\([^)]*\)|\"[^\"]*\"")
LIST_LINE = re.compile(r"\s*(?:[-•*–]|\d+[.)])\s")
INVISIBLE = re.compile("[­​-‏⁠﻿]")


def plain(s: str) -> str:
    return "".join(c for c in s.lower() if c.isalnum())


def _h(s: str, bits: int) -> int:
    return crc32(s.encode("utf-8", "replace")) & ((1 << bits) - 1)


class Language:
    """Naive Bayes over hashed words and character n-grams, trained on texts that function words tell apart."""

    def __init__(self) -> None:
        self.names = sorted(FUNCTION_WORDS)
        self.log = np.zeros((len(self.names), 1 << LANGUAGE_BITS))
        self.known: dict[str, list[float]] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        return [w for w in WORDS.findall(QUOTED.sub(" ", text).lower()) if not w.isdigit()]

    @staticmethod
    def grams(w: str) -> list[int]:
        p = f"^{w}$"
        return [_h(f"w{w}", LANGUAGE_BITS)] + [_h(p[i : i + n], LANGUAGE_BITS) for n in (2, 3) for i in range(len(p) - n + 1)]

    def word(self, w: str) -> list[float]:
        v = self.known.get(w)
        if v is None:
            v = self.log[:, self.grams(w)].sum(axis=1).tolist()
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[w] = v
        return v

    def train(self, texts: list[str]) -> Language:
        sets = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}
        count = np.full_like(self.log, 0.1)
        grams: dict[str, list[int]] = {}
        tally: dict[str, Counter] = {k: Counter() for k in self.names}
        for t in texts:
            w = WORDS.findall(QUOTED.sub(" ", t).lower())
            hits = sorted(((sum(x in sets[k] for x in w), k) for k in self.names), reverse=True)
            if hits[0][0] >= 3 and hits[0][0] >= 2 * hits[1][0]:
                for x in self.words(t):
                    if x not in grams:
                        grams[x] = self.grams(x)
                    tally[hits[0][1]][x] += 1
        for k, words in tally.items():
            c = count[self.names.index(k)]
            for x, n in words.items():
                for g in grams[x]:
                    c[g] += n
        self.log = np.log(count / count.sum(axis=1, keepdims=True))
        self.known = {}
        return self

    def tell(self, text: str) -> tuple[str, float, np.ndarray]:
        """(language, log odds against the next, log probabilities)."""
        v = [self.word(w) for w in self.words(text)]
        s = np.array([sum(x) for x in zip(*v)]) if v else np.zeros(len(self.names))
        a, b = np.argsort(-s, kind="stable")[:2]
        return self.names[a], float(s[a] - s[b]), s


def _bucket(x: float) -> int:
    return int(math.log2(x + 1) * 2) if x > 0 else 0


def features(q: str | None, a: str | None, language: Language) -> np.ndarray:
    """Hashed features of a pair: n-grams of the whole answer, its ending, what it takes from the question, both languages.

    Numbers from 1 << BITS on are n-grams, and a negative one tells the answer's words, by which those are weighed.
    """
    q, a = q or "", INVISIBLE.sub("", a or "")
    s = a.strip()
    w = WORDS.findall(s.lower())
    n = len(w)
    f = ["1", f"n{_bucket(n)}", f"c{min(len(s), 8)}"]
    grams = [f"u{x}" for x in w if not x.isdigit()] + [f"b{x} {y}" for x, y in zip(w, w[1:])] + [f"t{x} {y} {z}" for x, y, z in zip(w, w[1:], w[2:])]
    f += [f"f{x} {y}" for x, y in zip(w[:7], w[1:8])]
    # the ending
    last = s.split("\n")[-1]
    tail = s.rstrip("*_`\"'”“»)]’")
    e = tail[-1:]
    end = "none" if not s else "stop" if e in ".!?。؟;" and not tail.endswith("...") else "more" if e == "…" or tail.endswith("...") else "colon" if e in ":,;–-(" else "word"
    listed = bool(LIST_LINE.match(last)) and "\n" in s
    open_p = s.count("(") > s.count(")")
    f += [f"e{end}{listed}", f"e{end}{listed}{open_p}", f"e{end}{listed}{n > 3}", f"e{end}{n == 0}"]
    # what comes from the question
    pq, pa_ = plain(q), plain(a)
    if pq:
        inside = pq in pa_
        rest = pa_.replace(pq, " ").strip() if inside else pa_
        wq = set(WORDS.findall(q.lower()))
        shared = sum(x in wq for x in w) / n if n else 0
        f += [f"q{inside}", f"q{inside}{_bucket(len(rest))}", f"q{inside}{len(rest) > 25}", f"q{inside}{end}{len(rest) > 25}", f"s{int(shared * 10)}", f"s{int(shared * 10)}{_bucket(n)}"]
        # refused or echoed words count only outside the copy
        if inside:
            f.append(f"q{len(pa_) // len(pq)}")
    # the languages
    lq, oq, sq = language.tell(q)
    la, oa, sa = language.tell(a)
    against = float(sa.max() - sa[language.names.index(lq)])
    same = lq == la
    f += [f"l{same}", f"l{same}{min(_bucket(against), 14)}{oq > 8}", f"l{same}{against > 12}{oq > 8}", f"l{same}{n > 3}{against > 12}"]
    return np.array([-n - 1, *{_h(x, BITS) for x in f}, *{_h(x, BITS) + (1 << BITS) for x in grams}], np.int32)


def weighed(f: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """(places among the weights, values) of a pair's features: n-grams of a long answer share the weight of FULL_WEIGHT words."""
    f = np.asarray(f)
    n = max(1, -int(f.min()) - 1)
    f = f[f >= 0]
    return f & ((1 << BITS) - 1), np.where(f >> BITS, math.sqrt(min(1.0, FULL_WEIGHT / n)), 1.0).astype(np.float32)


def calibrated(scores: np.ndarray, is_so: np.ndarray) -> tuple[float, float]:
    """(slope, base) of the logistic curve through held-out scores, by Newton's method; (1, 0) without both kinds.

    Targets are drawn in by one example of each kind, so that kinds which are parted cleanly keep a finite curve.
    """
    n1, n0 = int(is_so.sum()), int((~is_so).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(is_so, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([scores, np.ones_like(scores)])
    w, damp = np.array([1.0, 0.0]), 1e-3
    loss = lambda v: float(np.logaddexp(0, v @ x).sum() - (t * (v @ x)).sum())
    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + damp * np.eye(2), x @ (p - t))
        new = loss(w - step)
        if new < now:
            w, damp, gain, now = w - step, damp / 4, now - new, new
            if gain < 1e-9:
                break
        elif (damp := damp * 8) > 1e12:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


class Classifier:
    """One logistic regression a defect over shared hashed features, each with its scores calibrated to log odds."""

    def __init__(self) -> None:
        self.w = np.zeros((len(DEFECTS), 1 << BITS), dtype=np.float32)
        self.slope, self.base = np.ones(len(DEFECTS)), np.zeros(len(DEFECTS))
        self.language = Language()

    def score(self, f: Iterable[int]) -> np.ndarray:
        at, x = weighed(f)
        return self.w[:, at] @ x

    def train(self, rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, seed: int = 11) -> Classifier:
        """AdaGrad over examples (features, index of the defect or -1); a quarter is held out to calibrate the scores."""
        rnd = random.Random(seed)
        rows = list(rows)
        rnd.shuffle(rows)
        held, rows = rows[: len(rows) // 4], rows[len(rows) // 4 :]
        g2 = np.full_like(self.w, 1e-2)
        for _ in range(epochs):
            rnd.shuffle(rows)
            for f, y in rows:
                f, x = weighed(f)
                z = np.clip(self.w[:, f] @ x, -30, 30)
                g = 1 / (1 + np.exp(-z))
                if y >= 0:
                    g[y] -= 1
                g = g[:, None] * x
                s = g2[:, f] + g * g
                g2[:, f] = s
                self.w[:, f] -= 0.3 * g / np.sqrt(s)
        scores = np.array([self.score(f) for f, _ in held]).reshape(len(held), len(DEFECTS))
        ys = np.array([y for _, y in held])
        for k in range(len(DEFECTS)):
            self.slope[k], self.base[k] = calibrated(scores[:, k], ys == k)
        return self

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """Log odds of each defect, as calibrated on the examples held out."""
        return self.slope * scores + self.base

    def defect(self, q: str | None, a: str | None) -> str | None:
        over = self.chances(self.score(features(q, a, self.language)))
        k = int(over.argmax())
        return DEFECTS[k] if over[k] > 0 else None


def _reformat(q: str, rnd: random.Random) -> str:
    x = rnd.choice((str, str, str.upper, str.lower, str.title, str.swapcase))(q)
    r = rnd.random()
    if r < 0.15:
        x = x.rstrip("?.! ")
    elif r < 0.3:
        x = x.rstrip("?.! ") + "."
    elif r < 0.4:
        x = x.replace(" ", "  ")
    elif r < 0.5:
        x = rnd.choice(("> ", "- ", "• ", "*", "«", "“", "[", " ")) + x + rnd.choice(("", "*", "»", "”", "]", " "))
    elif r < 0.6:
        x = x.replace(" ", rnd.choice(("\n", "\t", " - ", "; ")), 1)
    return x


def examples(pairs: list[tuple[str | None, str | None]], language: Language, seed: int = 13) -> list[tuple[np.ndarray, int]]:
    """Training examples from logged pairs: sound answers, and the same made empty, cut, copied, swapped or refused.

    A logged answer is taken as sound if it ends its sentence or a list, doesn't lie within its question and is in the
    question's language; the few unsound ones that pass are outweighed by what is made from the others.
    """
    rnd = random.Random(seed)
    good: list[tuple[str, str, str]] = []
    by_language: dict[str, list[str]] = defaultdict(list)
    phrases = []
    for q, a in pairs:
        if not q or not a or len(plain(a)) < 2 or plain(a) in {plain(x) for x in PLACEHOLDERS}:
            continue
        lq, oq, _ = language.tell(q)
        la, oa, _ = language.tell(a)
        s = a.rstrip()
        ends = s[-1:] in ".!?" and not s.endswith("...") or bool(LIST_LINE.match(s.split("\n")[-1])) and "\n" in s
        rest = plain(a).replace(plain(q), "")
        if not ends or len(rest) < 40 and plain(q) in plain(a) or oq < 8 or oa > 8 and lq != la:
            continue
        good.append((q, a, lq))
        if oa > 8:
            by_language[la].append(a)
        m = re.findall(r"\b(?:the|all|each|every) \w+ \w+", a)
        phrases += m[:1]
    # short answers and refusals among the sound ones are told by what is made below; drop those made of refusal parts
    parts = {plain(x)[:40] for _, whole, _ in REFUSALS.values() for x in whole}
    refused = lambda a: len(a) < 220 and any(p in plain(a) for p in parts)
    good = [g for g in good if not refused(g[1])]
    out: list[tuple[np.ndarray, int]] = []
    add = lambda q, a, y: out.append((features(q, a, language), DEFECTS.index(y) if y else -1))
    langs = [k for k in by_language if len(by_language[k]) > 5]
    for i, (q, a, lang) in enumerate(good):
        add(q, a, None)
        r = i % 8
        if r == 0:
            add(q, rnd.choice(PLACEHOLDERS), "empty")
        elif r in (1, 2):
            body = a.split("\n")[0] if "\n" in a and not LIST_LINE.match(a) else a
            if len(body) > 40:
                at = rnd.randrange(12, len(body) - 3)
                x = body[:at].rstrip()
                if x[-1:] in ".!?)":
                    x = x.rstrip(".!?) ")
                add(q, x + rnd.choice(("", "", "", "…", ", including:", ":", "...", " (")), "truncated")
        elif r in (3, 4):
            x = _reformat(q, rnd)
            kind = rnd.random()
            if kind < 0.3:
                x = rnd.choice(ANNOUNCED.get(lang, ANNOUNCED["en"]) + ANNOUNCED["en"]) + x
            elif kind < 0.5:
                x = x + rnd.choice((" ", "\n")) + _reformat(q, rnd)
            elif kind < 0.6:
                x = rnd.choice(ANNOUNCED.get(lang, ANNOUNCED["en"])) + " ".join(_reformat(q, rnd) for _ in range(rnd.randrange(2, 5)))
            add(q, x, "copied")
            # an announced question followed by an answer is sound
            if rnd.random() < 0.5:
                add(q, rnd.choice(ANNOUNCED.get(lang, ANNOUNCED["en"])) + q + " " + a, None)
        elif r == 5 and len(langs) > 1:
            other = rnd.choice([k for k in langs if k != lang])
            x = rnd.choice(by_language[other])
            add(q, x, "other_language")
            add(q, a + f" “{' '.join(x.split()[3:9])}”.", None)
        elif r in (6, 7):
            use = lang if lang in REFUSALS and rnd.random() < 0.85 else "en"
            head, whole, foot = REFUSALS[use]
            for _ in range(3):  # as many short ones as are long or have sound counterparts
                h, x = rnd.choice(head), rnd.choice(whole)
                x = h + (x if h and h.rstrip()[-1:] not in (".", "") else x[0].upper() + x[1:]) + rnd.choice(foot)
                # a refusal in another language is a refusal
                add(q, x, "refusal")
            # the same with much said around it, and the same said around an answer
            before, after = AROUND[use]
            p, s = rnd.sample(before, rnd.randrange(0, 4)), rnd.sample(after, rnd.randrange(0, 5))
            restated = rnd.choice(ANNOUNCED[use]) + q
            add(q, " ".join([*p, x, *s]), "refusal")
            # what the question is about may be told at length before it is declined
            add(q, " ".join([*p, restated, *[other for other, _, k in rnd.sample(good, min(len(good), rnd.randrange(3))) if k == lang], x, *s]), "refusal")
            if use == lang:
                add(q, " ".join([*p, a, *s]), None)
                add(q, " ".join([*p, restated, a, *s]), None)
            if phrases and rnd.random() < 0.7:
                limit = rnd.choice(LIMITS).format(rnd.choice(phrases))
                add(q, rnd.choice((f"{a} {limit}", f"{limit} {a}")), None)
            if rnd.random() < 0.2:
                add(q, rnd.choice({"en": ("Yes.", "No.", "Yes, always.", f"Within {rnd.randrange(2, 99)} days.", "No (Article 5)."), "de": ("Ja.", "Nein."), "fr": ("Oui.", "Non."), "es": ("Sí.", "No."), "it": ("Sì.", "No.")}.get(lang, ("No.",))), None)
    return out


def fit(df: DataFrame, query: str = "query", answer: str = "answer", pairs: int = TRAIN_PAIRS) -> Classifier:
    """A classifier trained on examples made from at most `pairs` logged pairs, those with the smallest hash."""
    h = F.xxhash64(F.lit(5), F.col(query), F.col(answer))
    rows = [(r[0], r[1]) for r in df.select(F.col(query), F.col(answer), h.alias("h")).orderBy("h", query, answer).limit(pairs).collect()]
    c = Classifier()
    c.language.train([x for r in rows for x in r if x])
    return c.train(examples(rows, c.language))


def defects(df: DataFrame, key: str = "response_id", query: str = "query", answer: str = "answer", model: Classifier | None = None) -> DataFrame:
    """(key, defect) of every pair with a defect, the likeliest one.

    A null or blank answer is empty whatever the question. A null or blank question leaves its answer to be judged
    alone, and never copied. Repeated rows each get their row.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or fit(df, query, answer))  # 2 ** BITS weights a defect
    kind = df.select(key).schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.defect(q, a) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            keep = pa.array([i for i, x in enumerate(got) if x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), pa.array([x for x in got if x], pa.string())], [key, "defect"])

    return widen(df.select(key, query, answer)).mapInArrow(run, f"`{key}` {kind}, defect string")
