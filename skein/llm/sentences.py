"""Problem 7: sentence boundaries across languages and scripts.

Candidates are runs of characters with the Unicode sentence-break property STerm
or ATerm, in every script. Closing quotes and brackets after a run belong to it.
A candidate is dropped if the run stands within a quotation or bracket that goes
on, if what follows goes on in lower case, if a full stop ends an abbreviation,
an initial, an ordinal or a part of a number, name or address. Blank lines always
divide; in Thai so does white space between two Thai words.

Suppression is language-specific: an abbreviation that is a word as well ("no",
"art", "max") counts only in a text that holds its language, told by function
words, and even there, like a single capital letter, ends a sentence before a
capitalised function word. Other abbreviations cannot be mistaken. All steps are linear in the length of a text; a word
before a mark is looked at over its last `TOKEN` characters.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Abbreviations that do not end a sentence, by language.
NEVER = {
    "en": "mr mrs ms dr prof st vs fig figs sec no nos pp vol ed eds eq approx max min dept gen rev hon capt col sgt e.g i.e cf viz ca ref ch art",
    "de": "dr prof hr fr nr abb ca bzgl bzw z b d h u a vgl ggf evtl inkl exkl s o str sog mind max min geb gest",
    "fr": "m mm dr pr no n° p ex env art chap fig vol cf av boul",
    "es": "sr sra srta dr dra ud uds núm nº pág págs aprox art fig vol cap av prof p ej",
    "ru": "см рис табл г гг т е д п ч стр им ул просп проф акад тыс млн млрд руб коп др",
    "other": "डॉ श्री प्रो د أ م ص",
}
#: Those of them that are words as well.
WORDS_TOO = set("no nos art max min fig sec ed gen rev hon ref ch cap vol eq p m z b d u a h s o".split())
#: Function words of languages written in Latin letters.
FUNCTION = {
    "en": "the of and a to in is that it for on was with as by at this are not be or from an have which he she we they you i his her its their then there if but so these those when what how who where our your will can has had were do does did than into each all no",
    "de": "der die das und in den von zu mit ist sich des ein eine einer einem einen auf für nicht wird im dem auch es an als er sie wir ihr ich aus bei nach nur noch so wenn aber oder wie was wer wo sind war werden hat haben kann diese dieser dieses man",
    "fr": "le la les de des du et en un une que qui est pour dans par au aux sur il elle ne se pas plus nous vous ils elles on ce cette ces son sa ses avec mais ou où si sont était être leur leurs comme je tu y",
    "es": "el la los las de del y en que a se un una por con no su sus para es al lo como más o pero si este esta estos estas ese esa son era ser hay fue nos él ella ellos ellas yo tú cuando donde cada",
}
#: Characters of a word before a mark that are looked at.
TOKEN = 256
#: These end a sentence if what follows does not go on in lower case.
MAY_END = set("etc usw a.m p.m inc ltd co corp jr sr p.ex ff т.д т.п".split())
#: Words before which a number with a full stop is an ordinal.
ORDINAL_AFTER = set("im am vom zum der die das dem den des ab bis beim ins seit".split())
_FUNCTION = {g: frozenset(x.split()) for g, x in FUNCTION.items()}
_PLAIN = regex.compile(r"\p{Latin}+")

_MARKS = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…]+")
_CLOSE = regex.compile(r"(?:[\p{Pe}\p{Pf}\"'“‘]|[   ](?=»))*")
_LETTER = regex.compile(r"\p{L}\.")
_AFTER_LETTER = regex.compile(r"(?:^|[^\p{L}\p{N}])\p{L}\.\s?$")
_GAP = regex.compile(r"\n[^\S\n]*\n\s*| \s*")
_THAI = regex.compile(r"(?<=\p{Thai})\s+(?=\p{Thai})")
_BREAK = regex.compile(r"(?r)[\s\p{Ps}\p{Pi}\"'“„«¿¡]")
_OPEN = {"(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "«": "»", "‹": "›"}


_NEVER = {w: frozenset(g for g, x in NEVER.items() if w in x.split()) for x in NEVER.values() for w in x.split()}


class _Languages:
    """The languages of a text, told when first asked for."""

    def __init__(self, text: str):
        self.text, self.known = text, None

    def __call__(self) -> frozenset[str]:
        if self.known is None:
            self.known = languages(self.text)
        return self.known

    def suppresses(self, low: str) -> bool:
        """Whether a word is an abbreviation in one of them."""
        of = _NEVER.get(low)
        return of is not None and (low not in WORDS_TOO or "ru" in of or not of.isdisjoint(self()))


@cache
def _starters(languages: frozenset[str]) -> frozenset[str]:
    return frozenset().union(*(_FUNCTION[g] for g in languages))


def languages(text: str) -> frozenset[str]:
    """The languages in Latin letters whose function words make up at least a fifth as much of a text as the likeliest one's; all if there are none."""
    words = Counter(_PLAIN.findall(text.lower()))
    hits = {g: sum(words[w] for w in f if w in words) for g, f in _FUNCTION.items()}
    most = max(hits.values())
    return frozenset(g for g, n in hits.items() if 5 * n >= most)


class _Spans:
    """Quotations and brackets that are closed within a paragraph."""

    def __init__(self, text: str):
        out, stack, straight = [], [], -1
        waiting: dict[str, list[int]] = {}  # by closing sign the depths that wait for it; may hold depths that are gone

        def push(closers, i):
            for c in closers:
                waiting.setdefault(c, []).append(len(stack))
            stack.append((closers, i))

        for m in regex.finditer(r"[()\[\]{}「」『』（）【】《》«»‹›“”„\"]", text):
            c, i = m.group(), m.start()
            if c == '"':
                if straight < 0:
                    straight = i
                else:
                    out.append((straight, i))
                    straight = -1
            elif c == "„":
                push("“”", i)
            elif c == "“" and not (stack and stack[-1][0] == "“”"):
                push("”", i)
            elif c in _OPEN:
                push(_OPEN[c], i)
            else:
                depths = waiting.get(c, [])
                while depths and (depths[-1] >= len(stack) or c not in stack[depths[-1]][0]):
                    depths.pop()
                if depths:
                    out.append((stack[depths[-1]][1], i))
                    del stack[depths[-1] :]
        out.sort()
        self.begins = [s for s, _ in out]
        self.reach = np.maximum.accumulate([e for _, e in out]).tolist() if out else []
        self.ends = {e for _, e in out}

    def around(self, after: int, until: int) -> bool:
        """Whether one begins before `after` and ends at `until` or later."""
        k = bisect_left(self.begins, after)
        return k > 0 and self.reach[k - 1] >= until


def _word(text: str, begin: int, i: int) -> int:
    """Where the word that ends at `i` begins."""
    low = max(begin, i - TOKEN)
    m = _BREAK.search(text, low, i)
    return m.end() if m else low


def _opens(text: str, p: int, known: _Languages) -> bool:
    """Whether a capitalised function word follows."""
    if not text[p].isupper():
        return False
    word = _PLAIN.match(text, p, p + 16)
    return word is not None and word.group().lower() in _starters(known())


def _ends(text: str, begin: int, i: int, j: int, k: int, p: int, known: _Languages) -> bool:
    """Whether the run of marks ``text[i:j]``, closed up to `k`, ends a sentence; the next word is at `p`."""
    marks, closed = text[i:j], k > j
    nxt, after = text[p], text[p + 1 : p + 2]
    spaced = p > k
    cased = nxt.lower() != nxt.upper()
    goes_on = nxt.islower() and not after.isupper() and not after.isdigit()
    if nxt in ",;:，、；：،؛" or (nxt in "—–-" and regex.match(r"[—–-]\s+\p{Ll}", text[p : p + 4])):
        return False
    wide = any(c in "。！？｡．" for c in marks)
    if wide:
        return not closed or spaced or nxt in "「『“《（"
    if set(marks) == {"…"} and not spaced:
        return False
    if goes_on:
        return False
    if closed and regex.search(r"\p{Devanagari}", text[max(begin, i - 12) : i]) and text[k - 1] in "\"”’'" and text[begin] in "\"“‘'":
        return False
    if not spaced:
        if any(c in "।॥؟۔" for c in marks):
            return True
        if nxt in "=&|<>/*+%)]}" or nxt.isdigit() or nxt in "_@#$^~\\":
            return False
        if closed:
            return cased or nxt in "¿¡«“„\"'(" or regex.match(r"\p{Lo}", nxt) is not None
        if "." not in marks:
            return True
        word = text[_word(text, begin, i) : i]
        if nxt.isupper() and after.islower() and (word.lower() in MAY_END or (word.lower() == "no" and i - begin < 9 and text[begin:i].strip() == word)):
            return True
        if regex.search(r"[/\\@]|://|\.\p{Ll}", word):
            return False
        if nxt.isupper():
            return (after.islower() or after.isspace() or not after) and regex.search(r"\p{Ll}\p{Ll}$|\p{Ll}{2}\d*$|(?:^|\s)\d+$|\p{Lo}{2}$|\p{M}$|[)\]]$", word) is not None
        return regex.match(r"[\p{Lo}¿¡«„“\"]", nxt) is not None and regex.search(r"[\p{Lo}\p{M}]{2}$|\p{Ll}{2}$|\d$", word) is not None and not known.suppresses(word.lower())
    if marks != ".":
        return True
    if closed:
        return True
    at = _word(text, begin, i)
    word = text[at:i]
    low = word.lower()
    alone = at - begin < 9 and not text[begin:at].strip("\"'“„«¿¡([ ")
    if low in MAY_END:
        return True
    if low in ("no", "nos") and not nxt.isdigit():
        # A whole sentence if it stands alone, the abbreviation before a number otherwise.
        return alone or _opens(text, p, known)
    # Letters that follow each other with their stops are one abbreviation.
    if len(word) == 1 and word.isalpha() and (_LETTER.match(text, p) or _AFTER_LETTER.search(text, max(begin, at - 4), at)):
        return False
    if known.suppresses(low):
        return low in WORDS_TOO and not (len(word) > 1 and word[0].isupper()) and _opens(text, p, known)
    if len(word) == 1 and word.isupper() and word != "I":
        return _opens(text, p, known)
    if len(word) == 1 and regex.match(r"[\p{Arabic}\p{Cyrillic}\p{Devanagari}]", word):
        return False
    if regex.fullmatch(r"(?:\p{L}\.)+\p{L}", word):
        return False
    if word.isdigit():
        if alone:
            return False
        before = text[max(begin, at - 40) : at].split()
        if before and before[-1].lower() in ORDINAL_AFTER and nxt.isupper():
            return False
    return True


def starts(text: str | None) -> list[int]:
    """Places (code points) of the first character of each sentence; none for null or blank text."""
    if not text:
        return []
    out: list[int] = []
    at = 0
    known = _Languages(text)
    for m in [*_GAP.finditer(text), None]:
        end = m.start() if m else len(text)
        out += _paragraph(text[at:end], at, known)
        at = m.end() if m else end
    return out


def _paragraph(text: str, shift: int, known: _Languages) -> list[int]:
    begin = len(text) - len(text.lstrip())
    if begin == len(text):
        return []
    out = [begin]
    stop = len(text.rstrip())
    spans = _Spans(text)
    thai = {m.end() for m in _THAI.finditer(text)} if regex.search(r"\p{Thai}", text) else set()
    found = []
    for m in _MARKS.finditer(text):
        k = _CLOSE.match(text, m.end()).end()
        p = k
        while p < stop and text[p].isspace():
            p += 1
        if p < stop:
            found.append((p, m.start(), m.end(), k))
    found += [(p, -1, -1, -1) for p in thai]
    found.sort()
    for p, i, j, k in found:
        if p <= out[-1]:
            continue
        if i < 0:
            if not spans.around(p, p):
                out.append(p)
            continue
        # A straight quote after the mark may open the next quotation instead of closing one.
        while k > j and text[k - 1] in "\"“‘'" and k - 1 not in spans.ends and k < len(text) and not text[k].isspace() and (k - 1 == j or text[k - 2].isspace()):
            if text[k - 1] == "'" and k - 1 == j:
                break
            k -= 1
            p = k
        if spans.around(i, k):
            continue
        if _ends(text, out[-1], i, j, k, p, known):
            out.append(p)
    return [x + shift for x in out]


def split(texts: DataFrame) -> DataFrame:
    """``(id, n, start, sentence)`` from ``(id, text)``: each sentence with its place, numbered from 0.

    A null, empty or blank text has no sentence. Sentences are given without
    the white space around them; texts are read whole and nothing is shuffled.
    """

    def run(batches):
        for b in batches:
            ids, numbers, at, parts = [], [], [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                s = starts(t)
                ids += [i] * len(s)
                numbers += range(len(s))
                at += s
                parts += [t[x:y].rstrip() for x, y in zip(s, [*s[1:], len(t or "")])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(np.array(numbers, np.int32)), pa.array(np.array(at, np.int64)), pa.array(parts, pa.string())],
                names=["id", "n", "start", "sentence"],
            )

    return texts.select("id", "text").mapInArrow(run, "id string, n int, start bigint, sentence string")
