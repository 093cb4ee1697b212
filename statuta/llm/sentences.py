"""Problem 10: sentences of documents in many languages and scripts, by a linear-chain tagger."""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.runtime import widen

#: Documents that the tagger is trained on at most, drawn by hash of the key, and passes over them.
TRAIN_DOCUMENTS = 6000
#: Longer documents aren't drawn for training.
TRAIN_CHARS = 20_000
EPOCHS = 4
#: Weights of the hashed features, for each of the two labels.
BITS = 18
#: Characters that may end a sentence, and those that close a quotation or parenthesis.
ENDS = ".!?;…。！？｡．؟؛۔।॥;"
OPENERS = {"(": ")", "[": "]", "“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "（": "）", "【": "】", "‘": "’", "‹": "›"}
CLOSERS = set(OPENERS.values()) | {'"', "'"}
MARKS = re.compile("[" + re.escape("".join(sorted(set(OPENERS) | CLOSERS))) + "]")
BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n\s*)+")
END_RUN = re.compile(f"[{re.escape(ENDS)}]+")
UNSPACED_SPACE = re.compile(r"(?<=[฀-๿຀-໿ក-៿က-႟0-9A-Za-z%)])[^\S\n]*\n?[^\S\n]*(?<=\s)(?=\S)")
WORD = re.compile(r"[^\s“”«»„「」『』（）()\"‘\[\]]+$")
OPENING = re.compile(r"\(?(?:\d+|[ivxlcIVXLC]+|[A-Za-z])\)?")
SPACE = re.compile(r"\s*")
WORD_END = re.compile(r"[\s.,;:!?]")
ROMAN = re.compile(r"[IVXLC]+$")
#: Scripts that mark no sentence ends; there blanks are the candidates.
UNPUNCTUATED = re.compile("[฀-๿຀-໿ក-៿က-႟]")


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches between blank lines, without surrounding white space."""
    at = 0
    for m in [*BLANK_LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        s = text[at:end]
        if t := s.strip():
            a = at + len(s) - len(s.lstrip())
            yield a, a + len(t)
        at = m.end() if m else len(text)


@lru_cache(100_000)
def _kind(c: str) -> str:
    if not c:
        return "none"
    o = ord(c)
    if c.isdigit():
        return "digit"
    if 0x3040 <= o <= 0x309F:
        return "kana"
    if c.isalpha():
        return "upper" if c.isupper() else "lower" if c.islower() else "letter"
    if c in OPENERS or c in "\"'¿¡":
        return "open"
    return "punct"


@lru_cache(100_000)
def _script(c: str) -> str:
    o = ord(c) if c else 0
    for name, a, b in (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xEFF), ("cjk", 0x3000, 0x9FFF)):
        if a <= o <= b:
            return name
    return "other"


def depths(p: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost quotations and parentheses of a paragraph; marks without a partner don't count.

    A straight or raised mark between two letters is an apostrophe. One pass, however many marks are never closed.
    """
    pairs, stack = [], []
    open_: Counter = Counter()
    for m in MARKS.finditer(p):
        i, c = m.start(), m.group()
        before, after = p[i - 1 : i], p[i + 1 : i + 2]
        if c in "'’" and before.isalpha() and after.isalpha():
            continue
        if stack and c == stack[-1][1]:
            pairs.append((stack.pop()[0], i + 1))
            open_[c] -= 1
        elif c in "\"'":
            if not before.isalnum() and not after.isspace() and after:
                stack.append((i, c))
                open_[c] += 1
        elif c in OPENERS:
            stack.append((i, OPENERS[c]))
            open_[OPENERS[c]] += 1
        elif open_[c]:  # an inner mark was never closed
            while stack[-1][1] != c:
                open_[stack.pop()[1]] -= 1
            pairs.append((stack.pop()[0], i + 1))
            open_[c] -= 1
    out, left = [], len(p) + 1
    for x, y in reversed(pairs):  # pairs come by their ends, an outer one after those inside it
        if y <= left:
            out.append((x, y))
            left = x
    return out[::-1]


def candidates(p: str) -> list[tuple[int, int, bool]]:
    """(start of the end mark, end of the candidate, whether it is surely inside a sentence) of a paragraph, its end left out."""
    spans = depths(p)
    out, k = [], 0
    for m in END_RUN.finditer(p):
        a, e = m.span()
        while True:  # closing marks belong to the sentence, also behind a blank if their opener is before it
            j = e
            while j < len(p) and p[j] in "   \n" and j - e < 2:
                j += 1
            if j < len(p) and p[j] in CLOSERS and any(s < a and f == j + 1 for s, f in _around(spans, j)):
                e = j + 1
            elif e < len(p) and p[e] in CLOSERS and not p[e + 1 : e + 2].isalnum():
                e += 1
            else:
                break
        if e >= len(p):
            continue
        c = p[e]
        if not c.isspace() and (_script(p[a]) == "cjk" or p[a] in "。！？｡．") is False and not (c.isupper() and p[a - 3 : a].isalpha() and p[a - 3 : a].islower()) and c not in OPENERS:
            continue
        # a number or letter that opens the paragraph belongs to its first sentence
        out.append((a, e, OPENING.fullmatch(p, 0, a) is not None or any(s < e < f for s, f in _around(spans, e))))
    if UNPUNCTUATED.search(p):
        for m in UNSPACED_SPACE.finditer(p):
            if UNPUNCTUATED.search(p[max(0, m.start() - 12) : m.end() + 12]) and not (out and any(e == m.start() for _, e, _ in out)):
                e = m.start()
                out.append((e, e, any(s < e < f for s, f in _around(spans, e))))
        out.sort(key=lambda x: x[1])
    return out


def _around(spans: list[tuple[int, int]], i: int) -> list[tuple[int, int]]:
    """Those of the spans, which are apart and in order, that i lies in or right behind."""
    k = bisect_right(spans, (i, 1 << 62))
    return [s for s in spans[max(0, k - 3) : k] if i <= s[1] + 1]


def token_type(p: str, a: int) -> str:
    """The word before an end mark as a type: digits and roman numbers with the word before, a single letter too."""
    m = WORD.search(p[max(0, a - 40) : a])
    w = m.group() if m else ""
    before = p[max(0, a - 80) : a - len(w)].split()
    prev = before[-1].lower() if before else ""
    if prev[-2:-1] in ("’", "'"):
        prev = prev[-1:]
    if "’" in prev:
        prev = prev.split("’")[-1]
    if re.fullmatch(r"\d{4}", w):
        return "year"
    if w.isdigit():
        return f"{prev} #" if not prev.isdigit() else "# #"
    if ROMAN.fullmatch(w):
        return f"{prev} R"
    if len(w) == 1:
        return f"1 {w.lower() if w.islower() else 'L'}"
    if any(c.isdigit() for c in w):
        return "mixed" + ("%" if w[-1] == "%" else "")
    return w.lower()


def _type(p: str, a: int, e: int) -> str:
    """As token_type; a semicolon goes by its script alone, as it ends sentences in some scripts and never in others."""
    if a == e:
        return "_"
    return f"mark {_script(p[a - 1 : a])}{p[a]}" if p[a] in ";؛" else token_type(p, a)


def _next(text: str, e: int) -> str:
    i = SPACE.match(text, e).end()
    return text[i : i + 24]


@lru_cache(200_000)
def _hash(s: str) -> int:
    return crc32(s.encode()) & ((1 << BITS) - 1)


def features(p: str, a: int, e: int, nxt: str) -> list[int]:
    """Hashed features of one candidate: what stands before the mark, the mark, and what follows it."""
    t = _type(p, a, e)
    mark = p[a : a + 1] if a < e else "_"
    run = p[a:e].strip()
    sc = _script(p[a - 1 : a])
    k = _kind(nxt[:1])
    lead = nxt.lstrip("¿¡“«„‘'\"(「（  ")
    word = WORD_END.split(lead.lower(), maxsplit=1)[0][:10]
    before = p[max(0, a - 60) : a].lower().split()
    f = [
        f"t {t}", f"t {t} {k}", f"m {mark} {sc} {k}", f"r {run[:4]} {k}", f"k {k}", f"w {word}", f"w {word} {mark}",
        f"p {before[-2] if len(before) > 1 else '^'} {k}", f"l {min(len(t), 7)} {k}", f"s {'.' in t} {k}",
        f"b {a - len(t) <= 2} {mark}", f"c {p[e - 1 : e]} {nxt[:1] if not nxt[:1].isalnum() else k} {sc}", "1",
    ]
    if a == e:
        x, y = p[a - 1 : a], nxt[:1]
        f += [f"x {p[a - 3 : a]}", f"y {nxt[:3]}", f"x1 {p[a - 1 : a].isdigit()}{y.isdigit()}", f"z {_script(x)} {_script(y)} {x.isdigit()} {y.isdigit()}"]
    return [_hash(s) for s in f]


def stripped(text: str) -> tuple[str, set[int]]:
    """A text with its end marks and blank lines taken out, one paragraph behind the other, and the places of the blanks
    where a sentence is known to end: a mark before white space, or a paragraph, stood there."""
    out, ends, n = [], set(), 0
    for a, b in paragraphs(text):
        p, at = text[a:b], 0
        for m in END_RUN.finditer(p):
            s, e = m.span()
            if e < len(p) and not p[e].isspace() or p[s - 1 : s].isdigit():
                continue  # inside a number or word
            out.append(p[at:s])
            n += s - at
            at = e
            ends.add(n)
        out.append(p[at:] + " ")
        n += len(p) - at
        ends.add(n)
        n += 1
    return "".join(out).rstrip(), ends


def examples(text: str, seed: int = 0) -> list[list[tuple[str, list[int], int, bool, str]]]:
    """Chains of a document's candidates as (type, features, weak label, inside, next), label -1 where nothing is known.

    A paragraph's end is a boundary. To show the tagger what such a boundary looks like inside running text, the end is
    paired with the beginning of another paragraph, as if the blank line were stripped. Texts in scripts without marks
    give a second chain, over the text stripped of all marks and blank lines: its boundaries are where those stood.
    """
    ps = [text[a:b] for a, b in paragraphs(text)]
    starts = [p for p in ps if p[:1].isalpha() or p[:1] in OPENERS or p[:1] in "¿¡"]
    rnd = random.Random(seed)
    out = []
    for p in ps:
        for a, e, inside in candidates(p):
            n = _next(p, e)
            out.append((_type(p, a, e), features(p, a, e, n), 0 if inside else -1, inside, n))
        m = re.search(f"[{re.escape(ENDS)}]+[{re.escape(''.join(CLOSERS))}]*$", p)
        n = rnd.choice(starts)[:24] if starts else ""
        if m and n:
            out.append((_type(p, m.start(), len(p)), features(p, m.start(), len(p), n), 2, False, n))
    chains = [out]
    if UNPUNCTUATED.search(text):
        bare, ends = stripped(text)
        chain = []
        for a, e, inside in candidates(bare):
            n = _next(bare, e)
            chain.append((_type(bare, a, e), features(bare, a, e, n), 2 if e in ends and a == e else 0 if inside else -1, inside, n))
        chains.append(chain)
    return chains


def weak_labels(docs: list[list[tuple[str, list[int], int, bool, str]]]) -> list[list[tuple[list[int], int]]]:
    """(features, label) chains: label 1 boundary, 0 inside, -1 left to the tagger."""
    final, inner, seen = Counter(), Counter(), Counter()
    for d in docs:
        for t, _, y, inside, n in d:
            if y == 2:
                final[t] += 1
            elif not inside:
                seen[t] += 1
                if _kind(n[:1]) in ("lower", "digit", "punct"):
                    inner[t] += 1
    chains = []
    for d in docs:
        chain = []
        for t, f, y, inside, n in d:
            k = _kind(n[:1])
            if y == 2:
                y = 1
            elif inside or k in ("lower", "punct", "kana") and t != "_":
                y = 0
            elif t == "_":
                y = 0 if k == "digit" else -1
            elif final[t] == 0 and (inner[t] > 0 or seen[t] >= 3 and len(t) <= 4 or " " in t or t[:2] == "1 "):
                y = 0
            elif k == "digit" and inner[t] > final[t]:
                y = 0
            elif final[t] > 0 or len(t) > 4 and inner[t] == 0:
                y = 1
            chain.append((f, y))
        chains.append(chain)
    return chains


class Tagger:
    """A linear-chain model over the candidates: hashed features, two labels, learned transitions, Viterbi decoding.

    Characters that can't end a sentence are inside with certainty, so decoding the candidates decodes all characters.
    A weight is what a feature speaks for a boundary rather than none.
    """

    def __init__(self) -> None:
        self.w = np.zeros(1 << BITS, dtype=np.float32)
        self.trans = np.zeros((2, 2), dtype=np.float32)
        self.weights: list[float] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"weights": []}

    def scores(self, chain: list[list[int]]) -> list[float]:
        """For each candidate, how much speaks for a boundary."""
        if not self.weights:
            self.weights = self.w.tolist()
        at = self.weights.__getitem__
        return [sum(map(at, f)) for f in chain]

    def decode(self, scores: list[float], known: list[int] | None = None) -> list[int]:
        """The best labels; `known` fixes those that aren't -1."""
        return _viterbi(scores, known, self.trans.tolist())

    def train(self, chains: list[list[tuple[list[int], int]]], epochs: int = EPOCHS, seed: int = 5) -> Tagger:
        """Averaged structured perceptron; what isn't labelled follows the best decoding that agrees with the labels."""
        chains = [c for c in chains if c]
        w, acc = [0.0] * (1 << BITS), [0.0] * (1 << BITS)
        trans, acc_t, step = [[0.0, 0.0], [0.0, 0.0]], np.zeros((2, 2)), 1
        rnd = random.Random(seed)
        for _ in range(epochs):
            rnd.shuffle(chains)
            for c in chains:
                known = [y for _, y in c]
                s = [sum(map(w.__getitem__, f)) for f, _ in c]
                got = _viterbi(s, None, trans)
                want = _viterbi(s, known, trans)
                if got != want:
                    for i, (g, y) in enumerate(zip(got, want)):
                        if g != y:
                            d = 2.0 * (y - g)
                            for k in c[i][0]:
                                w[k] += d
                                acc[k] += d * step
                        if i and (got[i - 1], g) != (want[i - 1], y):
                            trans[want[i - 1]][y] += 1
                            trans[got[i - 1]][g] -= 1
                            acc_t[want[i - 1], y] += step
                            acc_t[got[i - 1], g] -= step
                step += 1
        self.w = (np.array(w) - np.array(acc) / step).astype(np.float32)
        self.trans = (np.array(trans) - acc_t / step).astype(np.float32)
        self.weights = []
        return self


def _viterbi(scores: list[float], known: list[int] | None, trans: list[list[float]]) -> list[int]:
    """The best labels of a chain whose scores speak for label 1; `known` fixes those that aren't -1."""
    if not scores:
        return []
    (t00, t01), (t10, t11) = trans
    back = []
    v0 = v1 = 0.0
    for i, s in enumerate(scores):
        x0, x1 = 0.0, s
        if known and known[i] >= 0:
            x0, x1 = (-1e9, x1) if known[i] else (x0, -1e9)
        if i:
            a, b = v0 + t00, v1 + t10
            c, d = v0 + t01, v1 + t11
            back.append((int(b > a), int(d > c)))
            v0, v1 = max(a, b) + x0, max(c, d) + x1
        else:
            v0, v1 = x0, x1
    y = [int(v1 > v0)]
    for b in reversed(back):
        y.append(b[y[-1]])
    return y[::-1]


def spans(text: str | None, tagger: Tagger) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in code points."""
    if not text:
        return []
    out = []
    for a, b in paragraphs(text):
        p = text[a:b]
        cs = candidates(p)
        ends = []
        if cs:
            ys = tagger.decode(tagger.scores([features(p, i, e, _next(p, e)) for i, e, _ in cs]), [0 if inside else -1 for _, _, inside in cs])
            ends = [e for (_, e, _), y in zip(cs, ys) if y]
        at = 0
        for e in [*ends, len(p)]:
            s = p[at:e]
            if t := s.strip():
                i = a + at + len(s) - len(s.lstrip())
                out.append((i, i + len(t)))
            at = e
    return out


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", documents: int = TRAIN_DOCUMENTS) -> Tagger:
    """A tagger trained on at most `documents` documents, those with the smallest hash of their key."""
    rows = df.where(F.length(F.col(text)).between(1, TRAIN_CHARS)).select(F.col(text).alias("t"), F.xxhash64(F.lit(3), F.col(key)).alias("h"))
    docs = [c for i, r in enumerate(rows.orderBy("h", "t").limit(documents).collect()) for c in examples(r["t"], i)]
    return Tagger().train(weak_labels(docs))


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(key, start_pos, end_pos) of every sentence: 0-based code points of the text, end exclusive.

    Null, empty and blank texts give no rows; a document given twice gives its rows twice; a text of any length is cut
    whole, paragraph by paragraph.
    """
    tagger = tagger or fit(df, key, text)
    shared = df.sparkSession.sparkContext.broadcast(tagger)  # 2 ** BITS weights a label, whatever the corpus
    kind = df.select(key).schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                got = [spans(x, t) for x in part.column(1).to_pylist()]
                index = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
                flat = np.array([s for g in got for s in g], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), pa.array(flat[:, 0]), pa.array(flat[:, 1])], [key, "start_pos", "end_pos"])

    return widen(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, start_pos long, end_pos long")
