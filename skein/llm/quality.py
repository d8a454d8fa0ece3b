"""Problem 10: text statistics per document, their place among documents of the language, and the form.

One pass gives the statistics of each text. Per language, and over all, a mergeable
quantile sketch of each statistic (`percentile_approx`, combined within tasks first)
is built over all distinct texts: a text that is copied so often that it is most
of its language counts once. A value becomes a robust z-score by the sketch's
median and quartiles; a language with few texts is judged by the sketch over all.

The tails decide. A document is prose unless it lies in a tail, and which tails it lies
in tells what else it is: cells in nearly every line a table, entries in nearly
every line a list, and junk what has hardly any letters, repeats itself, holds coded
or garbled characters, or has few vowels or many symbols and hardly a common word.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut_lineage

STATISTICS = (
    "words", "mean_word_length", "symbol_share", "digit_share", "letter_share", "end_share", "common_share", "distinct_share", "vowel_share",
    "line_length", "entry_share", "cell_share", "odd_share", "longest_token_share",
)
COLUMNS = [*STATISTICS, "hex_share", "lines", "speakers"]
#: A value so many robust standard deviations from the median lies in a tail, and so many far out.
TAIL, FAR = 3.0, 10.0
#: Least robust standard deviations, where all texts of a language are alike in a statistic.
LEAST = {
    "words": 10, "mean_word_length": 0.3, "symbol_share": 0.025, "digit_share": 0.03, "letter_share": 0.075, "end_share": 0.1, "common_share": 0.03, "distinct_share": 0.065, "vowel_share": 0.012,
    "line_length": 20, "entry_share": 0.1, "cell_share": 0.05, "odd_share": 0.006, "longest_token_share": 0.05, "hex_share": 0.06, "lines": 2, "speakers": 0.1,
}
#: Share of the texts of a language with the fewest common words.
FEW_COMMON = 0.2
#: Distinct texts that a language needs for sketches of its own.
ENOUGH = 200

_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}_'’]+")
_PLAIN_WORD = re.compile(r"[\w'’]+")
_GAP = re.compile(r" {2,}")
_LETTER = regex.compile(r"[\p{L}\p{M}]")
_DIGIT = regex.compile(r"\p{Nd}")
_DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}]")
_ODD = regex.compile(r"�|%[0-9A-Fa-f]{2}|\\x[0-9a-fA-F]{2}|[\u0080-\u009F]|[ÃÂÐÑàáâãäåæçèéêëìíîïØÙ][\u0080-¿]")
_END = regex.compile(r"[.!?…。！？؟।۔;:：；][\"'”’»）)\]」』*_]*\s*$")
_MARK = regex.compile(r"^\s*(?:[-*+•·–—‣◦▪●○]|\[[ xX]\]|(?:\d+|[a-zA-Z])[.)]|\d+(?:\.\d+)+\.?|\(\w{1,3}\))\s+\S")
_LEADER = regex.compile(r"\S\s*\.{4,}\s*\d+\s*$")
_RULE = regex.compile(r"^[\s|+:=\-─━┼│┤├]+$")
_HEX = regex.compile(r"^[0-9a-fA-F]{6,16}:?\s+(?:[0-9a-fA-F]{2,4}\s?){4,}")
_SPEAKER = regex.compile(r"^\s*[QAFRPВОЖС]\s*[:：.]\s")
_LATIN = regex.compile(r"[a-zA-ZÀ-ɏ]")
_VOWEL = regex.compile(r"[aeiouyAEIOUYÀ-ÆÈ-ÏÒ-ÖØ-Ýà-æè-ïò-öø-ý]")
_BLOB = regex.compile(r"[A-Za-z0-9+/=_-]{40,}")


_KINDS: dict[str, int] = {}
_ALPHA, _MARKED, _DIGITS, _BLANK, _CJK, _ROMAN, _VOCAL, _SUSPECT = (1 << k for k in range(8))


def _kind(c: str) -> int:
    """Properties of a character as bits."""
    k = _KINDS.get(c)
    if k is None:
        k = _KINDS[c] = (
            (_ALPHA if _LETTER.match(c) else 0) | (_MARKED if unicodedata.category(c)[0] == "M" else 0) | (_DIGITS if _DIGIT.match(c) else 0) | (_BLANK if c.isspace() else 0)
            | (_CJK if _DENSE.match(c) else 0) | (_ROMAN if _LATIN.match(c) else 0) | (_VOCAL if _VOWEL.match(c) else 0) | (_SUSPECT if c in "�%\\" or "\x80" <= c <= "\xff" else 0)
        )
    return k


def _size(line: str, dense: int = 1) -> float:
    """Length of a line in characters, those of scripts without spaces counted twice."""
    return len(line) + len(_DENSE.findall(line)) if dense else len(line)


def _short(text: str, dense: int = 1) -> bool:
    """Whether a line's content is a short entry rather than a sentence."""
    t = text.strip()
    return 0 < len(t) <= 44 and t[-1] not in ".!?。！？؟।" and _size(t, dense) <= 44 and len(t.split()) <= 6


def _entry(line: str, dense: int) -> bool:
    if len(line) > 140:
        return False
    if _short(line, dense):
        return True
    return bool(_LEADER.search(line) or _MARK.match(line) and _short(line.split(None, 1)[1], dense))


def _cells(lines: list[str], text: str, dense: int) -> float:
    """The greatest share of lines that are rows of cells by one divider."""
    body = [x for x in lines if not _RULE.match(x)]
    if len(body) < 2:
        return 0.0
    best = 0.0
    for sign, split in (("|", None), ("\t", None), (";", None), (",", None), ("  ", _GAP)):
        if text.count(sign) < len(body) / 2:
            continue
        clauses = sign in ";,"
        counts: dict[int, int] = {}
        for x in body:
            if sign not in x:
                continue
            y = x.strip(" |") if sign == "|" else x.strip("\n") if sign == "\t" else x.strip()
            if clauses and y[-1:] in ".!?。！？":
                continue
            c = split.split(y) if split else y.split(sign)
            if len(c) < 2 or any(_size(z, dense) > 40 or len(z.split()) > 5 for z in c):
                continue
            counts[len(c)] = counts.get(len(c), 0) + 1
        rows = max(counts.values(), default=0)
        # Commas and semicolons also divide clauses: rows need the same number of cells.
        near = sum(counts.values()) if len(counts) <= 3 and not clauses else rows
        best = max(best, near / len(body) if rows >= 2 else 0.0)
    return best


class Vocabulary:
    """Common words by language, prepared for one look a text."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({g for g, _ in rows})
        self.of: dict[str, list[str]] = {}
        for g, w in rows:
            self.of.setdefault(w.lower(), []).append(g)
        self.dense = [w for w in self.of if _DENSE.match(w)]

    def share(self, words: Counter, n: int, text: str, dense: bool, cjk: int) -> float:
        """The greatest share over languages of words that are common."""
        hits: dict[str, int] = {}
        for w in words.keys() & self.of.keys():
            for g in self.of[w]:
                hits[g] = hits.get(g, 0) + words[w]
        if dense:
            for w in self.dense:
                k = text.count(w)
                for g in self.of[w]:
                    hits[g] = hits.get(g, 0) + k
        return min(1.0, max(hits.values(), default=0) / max(1, n + cjk // 4))


def statistics(text: str, common: Vocabulary) -> dict[str, float]:
    """The statistics of a text that is not blank; shares are from 0 to 1."""
    n = len(text)
    letters = digits = blank = cjk = latin = vocal = marked = suspect = 0
    for c, k in Counter(text).items():
        f = _kind(c)
        letters += k if f & _ALPHA else 0
        digits += k if f & _DIGITS else 0
        blank += k if f & _BLANK else 0
        cjk += k if f & _CJK else 0
        latin += k if f & _ROMAN else 0
        vocal += k if f & _VOCAL else 0
        marked += k if f & _MARKED else 0
        suspect += k if f & _SUSPECT else 0
    solid = max(1, n - blank)
    low = (_WORD if marked else _PLAIN_WORD).findall(text.lower())
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    dense = cjk > solid / 3
    if dense:
        units = {text[i : i + 6] for i in range(0, max(1, n - 5))}
        total = max(1, n - 5)
    else:
        units = set(zip(low, low[1:], low[2:])) if len(low) > 2 else {tuple(low)}
        total = max(1, len(low) - 2)
    tokens = text.split()
    return {
        "words": float(len(low) + cjk // 2),
        "mean_word_length": sum(map(len, low)) / max(1, len(low)),
        "symbol_share": (solid - letters - digits) / solid,
        "digit_share": digits / solid,
        "letter_share": letters / solid,
        "end_share": sum(1 for x in lines if _END.search(x, max(0, len(x) - 8))) / len(lines),
        "common_share": common.share(Counter(low), len(low), text, dense, cjk),
        "distinct_share": len(units) / total,
        "vowel_share": vocal / latin if latin > solid / 2 else 0.42,
        "line_length": (n + cjk) / len(lines),
        "entry_share": sum(1 for x in lines if _entry(x, cjk)) / len(lines),
        "cell_share": _cells(lines, text, cjk),
        "odd_share": sum(map(len, _ODD.findall(text))) / solid if suspect * 40 > solid else 0.0,
        "longest_token_share": sum(map(len, _BLOB.findall(text))) / solid if max(map(len, tokens)) >= 40 else 0.0,
        "hex_share": sum(1 for x in lines if _HEX.match(x)) / len(lines) if digits * 4 > solid else 0.0,
        "lines": float(len(lines)),
        "speakers": sum(1 for x in lines if _SPEAKER.match(x)) / len(lines),
    }


def form(z: dict, tail: float = TAIL, far: float = FAR):
    """The form of a document as a Column, from its z-scores `z`.

    What "nearly all lines" means is the definition of a list or table, 85 % or
    all but one; that they are in a tail as well is what sets the document apart.
    """
    nearly = F.least(F.lit(0.85), 1 - 1 / F.greatest(F.lit(1.0), "lines") - 1e-9)
    cells = (z["cell_share"] >= tail) & (F.col("cell_share") >= 0.75)
    entries = (z["entry_share"] >= tail) & (F.col("entry_share") >= 0.8)
    coded = (z["odd_share"] >= far) | (z["longest_token_share"] >= far) | (z["hex_share"] >= far)
    bare = (z["letter_share"] <= -far) & ~cells
    repeated = (z["distinct_share"] <= -far) & (F.col("words") >= 12) & ~cells & ~entries
    unread = F.col("common_share") <= F.col("common_share_low")
    random = (z["vowel_share"] <= -far / 2) & unread & ~cells
    symbols = (z["symbol_share"] >= far) & (z["letter_share"] <= -tail) & unread & ~cells & ~entries
    table = (z["cell_share"] >= tail) & (F.col("cell_share") >= nearly) & (F.col("lines") >= 3)
    listed = (z["entry_share"] >= tail) & (F.col("entry_share") >= nearly) & (F.col("lines") >= 4) & (F.col("speakers") < 0.5)
    return F.when(coded | bare | repeated | random | symbols, "junk").when(table, "table").when(listed, "list").otherwise("prose")


def measure(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``(id, lang, k1, k2, <statistics>)`` from ``(id, text, lang)``; null, empty and blank texts give no row.

    `common_words` is a fixed table of a few hundred rows; one of more than
    100,000 is refused. The language is its first two letters in lower case,
    ``und`` if that is no known one. ``k1`` and ``k2`` are hashes of the text.
    """
    rows = common_words.select("lang", "word").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too many common words to ship")
    common = Vocabulary([(r["lang"], r["word"]) for r in rows])

    def run(batches):
        for b in batches:
            ids, langs, at, out = [], [], [], []
            for n, (i, t, g) in enumerate(zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("lang").to_pylist())):
                if t and not t.isspace():
                    g = (g or "").strip().lower()[:2]
                    ids.append(i)
                    at.append(n)
                    langs.append(g if g in common.languages else "und")
                    out.append(statistics(t, common))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.column("id").type), pa.array(langs, pa.string()), b.column("k1").take(pa.array(at, pa.int64())), b.column("k2").take(pa.array(at, pa.int64())), *(pa.array([s[c] for s in out], pa.float64()) for c in COLUMNS)],
                names=["id", "lang", "k1", "k2", *COLUMNS],
            )

    kind = dict(documents.dtypes)["id"]
    rows = documents.select("id", "text", "lang", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    return rows.mapInArrow(run, f"id {kind}, lang string, k1 bigint, k2 bigint, " + ", ".join(f"{c} double" for c in COLUMNS))


def sketches(measured: DataFrame, accuracy: int = 10_000, enough: int = ENOUGH) -> DataFrame:
    """One row a language: median ``_mid`` and robust deviation ``_dev`` of each statistic, and ``common_share_low``.

    Sketches are taken over distinct texts, per language and over all; a
    language with less than `enough` of them gets those over all.
    """
    distinct = measured.groupBy("lang", "k1", "k2").agg(*[F.first(c).alias(c) for c in COLUMNS])
    points = [0.25, 0.5, 0.75, FEW_COMMON]
    q = distinct.rollup("lang").agg(F.count("*").alias("n"), *[F.percentile_approx(c, points, accuracy).alias(c) for c in COLUMNS])
    # One row a language of a fixed table, and one over all.
    q = q.select("lang", "n", F.struct(*COLUMNS).alias("own"))
    every = q.filter("lang IS NULL").select(F.col("own").alias("every"))
    q = q.filter("lang IS NOT NULL").join(F.broadcast(every)).select("lang", F.when(F.col("n") >= enough, F.col("own")).otherwise(F.col("every")).alias("q"))
    out = []
    for c in COLUMNS:
        x = F.col("q")[c]
        out += [x[1].alias(f"{c}_mid"), F.greatest((x[2] - x[0]) / 1.349, F.lit(float(LEAST[c]))).alias(f"{c}_dev")]
    return q.select("lang", *out, F.col("q.common_share")[3].alias("common_share_low"))


def judge(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``(id, lang, <statistics>, <statistic>_z, tails, form)`` of each document that is not blank."""
    measured = cut_lineage(measure(documents, common_words))
    # One row a language of the fixed table.
    joined = measured.join(F.broadcast(sketches(measured)), "lang")
    z = {c: (F.col(c) - F.col(f"{c}_mid")) / F.col(f"{c}_dev") for c in COLUMNS}
    scored = joined.select("id", "lang", *COLUMNS, "common_share_low", *[z[c].alias(f"{c}_z") for c in COLUMNS])
    z = {c: F.col(f"{c}_z") for c in COLUMNS}
    tails = F.array_compact(F.array(*[F.when(F.abs(z[c]) >= TAIL, F.lit(c)) for c in COLUMNS]))
    return scored.select("id", "lang", *COLUMNS, *[f"{c}_z" for c in COLUMNS], tails.alias("tails"), form(z).alias("form"))
