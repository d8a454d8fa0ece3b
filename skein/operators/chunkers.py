"""Chunkers as table functions: texts in, pieces with places and metadata out.

Sizes and places are characters (code points). A chunker works on spans of the
text, so pieces are slices of it, none exceeds ``max_chunk_size``, and together
they cover the text. Overlap is given beside a piece as ``context_before`` and
``context_after`` in its metadata, or with ``overlap_in_content`` joined to it;
windows of fixed size overlap themselves. Rows of ``(id, text)`` with a null or
blank text give no piece.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int, str]

# The patterns that texts are analysed with, and the names of the metadata.
_SENTENCE = re.compile(r"[.!?]+\s+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_HEADING = re.compile(r"^#{1,6}\s+")
_LIST = re.compile(r"^\s*[-*+]\s+")
_URL = re.compile(r"https?://\S+")
_EMAIL = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", re.ASCII)
_PHONE = re.compile(r"(?:\+?\d{1,3}[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b", re.ASCII)
_LINK = re.compile(r"\[[^\]]+\]\([^)]+\)")
_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]+\)")
_FENCED = re.compile(r"(?m)^```[\s\S]*?^```")
_COMMENT_SIGNS = ("//", "#", "/*", "*")
#: Words that mark a transition between sentences.
TRANSITIONS = ("however", "therefore", "furthermore", "moreover", "additionally", "consequently")


@dataclass(frozen=True)
class ChunkingConfig:
    max_chunk_size: int = 1000
    overlap_size: int = 100
    preserve_semantics: bool = True
    min_chunk_size: int = 100
    strategy: str = "adaptive"
    dynamic_sizing: bool = True
    context_window: int = 100
    overlap_in_content: bool = False

    def __post_init__(self):
        if not 0 <= self.overlap_size < self.max_chunk_size:
            raise ValueError("the overlap must be smaller than the size")
        if self.strategy not in ("adaptive", "fixed", "semantic", "hybrid"):
            raise ValueError(f"unknown strategy {self.strategy!r}")


# Windows and boundaries as Columns


def windows(text: str | Column, size: int, overlap: int) -> Column:
    """Array of ``(start, end)`` windows; a text within the size is one."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    n = F.char_length(F.col(text) if isinstance(text, str) else text)
    step = size - overlap
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - overlap) / step))
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("end")))


def boundaries(text: str | Column) -> Column:
    """Sorted places after ``. ! ? ;`` and line breaks, and the end."""
    c = F.col(text) if isinstance(text, str) else text
    n = F.char_length(c)
    marks = F.filter(F.transform(F.split(c, ""), lambda x, i: F.when(x.isin(".", "!", "?", ";", "\n"), i + 1)), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(marks, F.array(n))))


def metadata(source: str | Column, start: Column, end: Column) -> Column:
    return F.create_map(F.lit("source"), F.col(source) if isinstance(source, str) else source, F.lit("length"), (end - start).cast("string"), F.lit("start"), start.cast("string"), F.lit("end"), end.cast("string"))


def detect_language(text: str | Column) -> Column:
    """The program language told from the content."""
    c = F.col(text) if isinstance(text, str) else text
    return (
        F.when(c.contains("fn ") & c.contains("let "), "rust")
        .when(c.contains("def ") & c.contains("import "), "python")
        .when(c.contains("function ") | c.contains("const "), "javascript")
        .when(c.contains("public class "), "java")
        .otherwise("unknown")
    )


#: Program languages by file ending.
ENDINGS = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "go": "go", "rb": "ruby", "php": "php", "cs": "csharp", "kt": "kotlin", "swift": "swift"}


def language_of_file(name: str | Column) -> Column:
    ending = F.lower(F.element_at(F.split(F.col(name) if isinstance(name, str) else name, r"\."), -1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), ending), F.lit("unknown"))


# Spans


def _cut_at(text: str, pattern: re.Pattern, lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    hi = len(text) if hi is None else hi
    edges = [lo, *(m.end() for m in pattern.finditer(text, lo, hi)), hi]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _pack(spans: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Neighbouring spans joined as long as they stay within the limit."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and b - out[-1][0] <= limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _windows(a: int, b: int, size: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Windows over ``[a, b)``; the last reaches `b`."""
    out = []
    while b - a > size:
        out.append((a, a + size))
        a += size - overlap
    return [*out, (a, b)]


def _fit(spans: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Neighbouring spans packed within the limit; one that exceeds it alone is cut."""
    return [w for a, b in _pack(spans, limit) for w in _windows(a, b, limit)]


def _lines(text: str) -> list[tuple[int, int]]:
    return _cut_at(text, re.compile("\n"))


def document_spans(text: str, c: ChunkingConfig) -> list[Span]:
    """Paragraphs packed to the size; if one exceeds it, sentences packed instead; windows without semantics."""
    if not c.preserve_semantics:
        return [(a, b, "fixed") for a, b in _windows(0, len(text), c.max_chunk_size, c.overlap_size)]
    spans = _pack(_cut_at(text, _PARAGRAPH), c.max_chunk_size)
    if all(b - a <= c.max_chunk_size for a, b in spans):
        return [(a, b, "paragraph") for a, b in spans]
    return [(a, b, "sentence") for a, b in _fit(_cut_at(text, _SENTENCE), c.max_chunk_size)]


def _runs(text: str, kind_of, limit: int) -> list[Span]:
    """Runs of lines of one kind, packed within the limit. `kind_of` gives a line's kind and whether it begins a run."""
    runs: list[tuple[str, list[tuple[int, int]]]] = []
    for a, b in _lines(text):
        kind, begins = kind_of(text[a:b])
        if runs and runs[-1][0] == kind and not begins:
            runs[-1][1].append((a, b))
        else:
            runs.append((kind, [(a, b)]))
    return [(a, b, kind) for kind, lines in runs for a, b in _fit(lines, limit)]


def markdown_blocks(text: str, limit: int = 1 << 30) -> list[Span]:
    """Blocks by the kind of their lines."""
    fenced = False

    def kind_of(line: str):
        nonlocal fenced
        bare = line.strip()
        if bare.startswith("```"):
            fenced = not fenced
            return "code_block", fenced
        if fenced:
            return "code_block", False
        if _HEADING.match(bare):
            return "heading", True
        if _LIST.match(line) or re.match(r"\d+\.\s", bare):
            return "list", False
        if bare.startswith(">"):
            return "quote", False
        if bare.startswith("|"):
            return "table", False
        return ("paragraph" if bare else "empty"), False

    return _runs(text, kind_of, limit)


def markdown_spans(text: str, c: ChunkingConfig) -> list[Span]:
    """Sections by headings; with one section or none, blocks; lines without semantics."""
    limit = c.max_chunk_size
    if not c.preserve_semantics:
        return [(a, b, "mixed") for a, b in _fit(_lines(text), limit)]
    sections = _runs(text, lambda line: ("section", bool(_HEADING.match(line.strip()))), limit)
    return sections if len(sections) > 1 else markdown_blocks(text, limit)


_FUNCTION = re.compile(r"^\s*(?:(?:public|private|protected|pub|export|static|async)\s+)*(?:function|def|fn|func)\s+\w+")
_CLASS = re.compile(r"^\s*(?:(?:public|private|protected|pub|export|abstract|final)\s+)*(?:class|struct|interface|trait|enum|impl)\s+\w+")


def code_structures(text: str, limit: int) -> list[Span]:
    """Functions and classes up to where their braces or indentation end, and what stands between them."""
    inside, depth, indent, opened = "", 0, 0, False

    def kind_of(line: str):
        nonlocal inside, depth, indent, opened
        bare, lead = line.strip(), len(line) - len(line.lstrip())
        # Over when its braces closed, or, without braces, at a line that is indented no further.
        if inside and depth == 0 and bare and (opened or lead <= indent) and not bare.startswith(("}", ")", "]", "{")):
            inside = ""
        begins = False
        if not inside:
            inside = "function" if _FUNCTION.match(line) else "class" if _CLASS.match(line) else ""
            if inside:
                begins, indent, opened = True, lead, False
        kind = inside or "mixed"
        if inside:
            depth = max(0, depth + line.count("{") - line.count("}"))
            opened = opened or "{" in line
        return kind, begins

    return _runs(text, kind_of, limit)


def code_blocks(text: str, limit: int) -> list[Span]:
    """Runs of imports, comments, function and class heads, variables and other code."""

    def kind_of(line: str):
        bare = line.strip()
        if bare.startswith(("import ", "use ", "from ")):
            return "imports", False
        if bare.startswith(("//", "#", "/*")):
            return "comments", False
        if _FUNCTION.match(line):
            return "function", False
        if _CLASS.match(line):
            return "class", False
        return ("variables" if bare.startswith(("const ", "let ", "var ")) else "code"), False

    return _runs(text, kind_of, limit)


def code_spans(text: str, c: ChunkingConfig) -> list[Span]:
    """Structures; with one or none, logical blocks; lines without semantics."""
    limit = c.max_chunk_size
    if not c.preserve_semantics:
        return [(a, b, "mixed") for a, b in _fit(_lines(text), limit)]
    found = code_structures(text, limit)
    return found if len(found) > 1 and any(k != "mixed" for _, _, k in found) else code_blocks(text, limit)


class Analysis:
    """Where sentences, paragraphs, lines and addresses are, to tell the content type from any place on."""

    def __init__(self, text: str):
        self.text = text
        at = lambda p: [m.start() for m in p.finditer(text)]
        self.sentences, self.paragraphs, self.breaks = at(_SENTENCE), at(_PARAGRAPH), at(re.compile("\n"))
        self.addresses = sorted(at(_URL) + at(_EMAIL) + at(_PHONE))

    def counts(self, start: int = 0) -> tuple[int, int, int, int]:
        """Lines, sentences, paragraph breaks and addresses from `start` on."""
        after = lambda places: len(places) - bisect_left(places, start)
        n = len(self.text)
        lines = after(self.breaks) + (n > start and self.text[n - 1] != "\n")
        return lines, after(self.sentences), after(self.paragraphs), after(self.addresses)

    def kind(self, start: int = 0) -> str:
        lines, sentences, paragraphs, addresses = self.counts(start)
        if paragraphs > lines // 3:
            return "structured"
        if sentences > lines // 2:
            return "narrative"
        return "technical" if addresses else "mixed"

    def size(self, c: ChunkingConfig, start: int = 0) -> int:
        """The size for the content type from `start` on, within the configured bounds."""
        if not c.dynamic_sizing:
            return c.max_chunk_size
        factor = {"structured": 1.2, "narrative": 0.8}.get(self.kind(start), 1.0)
        return min(c.max_chunk_size, max(c.min_chunk_size, min(int(c.max_chunk_size * factor), c.max_chunk_size)))


def content_type(text: str) -> str:
    return Analysis(text).kind()


def dynamic_size(text: str, c: ChunkingConfig) -> int:
    return Analysis(text).size(c)


def _first_mark(marks: list[int], lo: int, hi: int) -> int | None:
    """The first semantic boundary in ``[lo, hi]``."""
    k = bisect_left(marks, lo)
    return marks[k] if k < len(marks) and marks[k] <= hi else None


def production_spans(text: str, c: ChunkingConfig) -> list[Span]:
    """By strategy; the adaptive one takes paragraphs for structured texts, windows for narrative ones, both for
    technical ones, and for others walks on by the size that suits what is left.

    Windows end at the first boundary within 100 characters around their end
    that keeps the size, and the next begins no later than that.
    """
    size, n = c.max_chunk_size, len(text)
    info = Analysis(text)
    strategy = c.strategy
    if strategy == "adaptive":
        strategy = {"structured": "semantic", "narrative": "fixed", "technical": "hybrid"}.get(info.kind(), "adaptive")
    if strategy in ("semantic", "hybrid"):
        overlap = c.overlap_size if strategy == "hybrid" else 0
        return [(x, y, strategy) for a, b in _pack(_cut_at(text, _PARAGRAPH), size) for x, y in _windows(a, b, size, overlap)]
    marks = sorted({m.end() for m in re.finditer(r"[.!?\n;]", text)} | {n})
    out: list[Span] = []
    at = 0
    while strategy == "fixed":
        end = min(n, at + size)
        if end < n and c.preserve_semantics:
            end = _first_mark(marks, max(at + c.overlap_size + 1, end - 100), end) or end
        out.append((at, end, strategy))
        if end == n:
            return out
        at = max(at + 1, end - c.overlap_size)
    while at < n:
        target = info.size(c, at)
        end = n if n - at <= target else _first_mark(marks, at + max(1, int(0.8 * target)), min(at + int(1.2 * target), at + size)) or at + target
        out.append((at, end, strategy))
        at = end
    return out


CHUNKERS = {"document": document_spans, "text": document_spans, "markdown": markdown_spans, "md": markdown_spans, "code": code_spans, "source": code_spans, "production": production_spans}


def create(name: str | None):
    """A chunker by name in any letter case; an unknown name gives the one for documents."""
    return CHUNKERS.get((name or "").lower(), document_spans)


# Quality and metadata


def syllables(word: str) -> int:
    groups = len(re.findall(r"[aeiouy]+", word.lower()))
    return max(1, groups - (word.lower().endswith("e") and groups > 1))


def quality(text: str) -> dict[str, float]:
    words, sentences = text.split(), _SENTENCE.split(text)
    if not words:
        scores = [0.0, 0.0, 1.0, 0.0]
    else:
        flesch = 206.835 - 1.015 * len(words) / len(sentences) - 84.6 * sum(map(syllables, words)) / len(words)
        moved = sum(any(w in s.lower() for w in TRANSITIONS) for s in sentences[1:])
        ended = sum(s.strip().endswith((".", "!", "?")) for s in sentences)
        scores = [
            min(1.0, max(0.0, flesch / 100)),
            (len(set(words)) / len(words) + len(words) / len(text)) / 2,
            moved / (len(sentences) - 1) if len(sentences) > 1 else 1.0,
            ended / len(sentences),
        ]
    names = ("readability", "information_density", "semantic_coherence", "structural_integrity")
    return dict(zip(names, scores)) | {"overall": sum(scores) / 4}


def language_of(text: str) -> str:
    """The program language told from the content, as `detect_language` does."""
    if "fn " in text and "let " in text:
        return "rust"
    if "def " in text and "import " in text:
        return "python"
    if "function " in text or "const " in text:
        return "javascript"
    return "java" if "public class " in text else "unknown"


def describe(name: str, text: str, kind: str, start: int = 0, line: int = 0, language: str = "", heading: str | None = None, strategy: str = "") -> dict[str, str]:
    """The metadata of a piece by its chunker."""
    lines = text.splitlines()
    words = text.split()
    empty = sum(not x.strip() for x in lines)
    share = lambda k: f"{k / len(lines) if lines else 0.0:.2f}"
    if name in ("markdown", "md"):
        texts = sum(1 for x in lines if x.strip() and not _HEADING.match(x.strip()) and not _LIST.match(x) and not x.strip().startswith("```"))
        out = {
            "chunking_method": "markdown", "block_type": kind, "line_count": len(lines), "char_count": len(text), "text_lines": texts, "empty_lines": empty,
            "heading_count": sum(bool(_HEADING.match(x.strip())) for x in lines), "code_block_count": len(_FENCED.findall(text)), "list_count": sum(bool(_LIST.match(x)) for x in lines),
            "link_count": len(_LINK.findall(text)), "image_count": len(_IMAGE.findall(text)), "start_line": line, "content_density": share(texts),
        }
        if heading is not None:
            out["heading"] = heading
    elif name in ("code", "source"):
        comments = sum(x.strip().startswith(_COMMENT_SIGNS) for x in lines)
        out = {
            "chunking_method": "code", "language": language, "block_type": kind, "line_count": len(lines), "char_count": len(text), "code_lines": len(lines) - comments - empty, "comment_lines": comments, "empty_lines": empty,
            "function_count": sum(bool(_FUNCTION.match(x)) for x in lines), "class_count": sum(bool(_CLASS.match(x)) for x in lines), "complexity": text.count("{") + text.count("("), "start_line": line, "comment_ratio": share(comments),
        }
    elif name == "production":
        info = Analysis(text)
        _, sentences, paragraphs, _ = info.counts()
        scores = quality(text)
        out = {
            "chunking_method": "production", "strategy": strategy or kind, "word_count": len(words), "sentence_count": len(_SENTENCE.split(text)), "paragraph_count": len(_PARAGRAPH.split(text)), "char_count": len(text), "start_index": start,
            "content_type": info.kind(), "avg_sentence_length": f"{len(text) / sentences if sentences else 0.0:.2f}", "avg_paragraph_length": f"{len(text) / paragraphs if paragraphs else 0.0:.2f}",
            "readability_score": f"{scores['readability']:.3f}", "information_density": f"{scores['information_density']:.3f}", "semantic_coherence": f"{scores['semantic_coherence']:.3f}",
            "structural_integrity": f"{scores['structural_integrity']:.3f}", "overall_quality": f"{scores['overall']:.3f}",
        }
    else:
        out = {
            "chunking_method": "document", "word_count": len(words), "sentence_count": len(_SENTENCE.findall(text)) + 1, "paragraph_count": len(_PARAGRAPH.findall(text)) + 1,
            "avg_word_length": f"{sum(map(len, words)) / max(1, len(words)):.2f}", "start_index": start,
        }
    return {k: str(v) for k, v in out.items()}


def contexts(name: str, text: str, c: ChunkingConfig, pieces: list[Span], k: int, heads: list) -> tuple[str, str]:
    """What a piece shares with the one before and the one after, by the rule of its chunker."""
    a, b, kind = pieces[k]
    if not c.overlap_size:
        return "", ""
    before = pieces[k - 1] if k else None
    if name in ("code", "source"):
        # The last lines of a related block: about 50 characters a line, at most 5.
        if before and (before[2] == kind or (before[2] in ("function", "class") and kind == "code")):
            last = text[before[0] : before[1]].splitlines(keepends=True)
            return "".join(last[-min(5, c.overlap_size // 50) :]) if min(5, c.overlap_size // 50) else "", ""
        return "", ""
    if name in ("markdown", "md"):
        if before and heads[k] is not None and heads[k - 1] is not None and (heads[k] in heads[k - 1] or heads[k - 1] in heads[k]):
            return text[max(before[0], before[1] - c.overlap_size) : before[1]], ""
        return "", ""
    if name == "production":
        size = min(c.context_window, c.overlap_size)
        return (text[before[1] - size : before[1]], "") if before and before[1] - before[0] >= size else ("", "")
    if kind == "fixed":  # windows overlap themselves
        return "", ""
    after = pieces[k + 1] if k + 1 < len(pieces) else None
    return (text[max(before[0], before[1] - c.overlap_size) : before[1]] if before else "", text[after[0] : min(after[1], after[0] + c.overlap_size)] if after else "")


def chunk(texts: DataFrame, config: ChunkingConfig | None = None, chunk_type: str | Column = "document") -> DataFrame:
    """``(id, n, content, start_index, end_index, chunk_type, metadata)`` from ``(id, text)``.

    `chunk_type` is a name for all or a Column; an unknown or null one is a
    document. ``content`` is exactly its slice of the text, unless the config
    says that the contexts are joined to it.
    """
    c = config or ChunkingConfig()
    kind = dict(texts.dtypes)["id"]
    rows = texts.select("id", "text", (F.lit(chunk_type) if isinstance(chunk_type, str) else chunk_type).alias("t")).filter("text IS NOT NULL AND trim(text) <> ''")

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for i, text, t in zip(*(b.column(k).to_pylist() for k in ("id", "text", "t"))):
                name = (t or "").lower() if (t or "").lower() in CHUNKERS else "document"
                pieces = [s for s in CHUNKERS[name](text, c) if not text[s[0] : s[1]].isspace()]
                language = language_of(text) if name in ("code", "source") else ""
                heads, head, line, at = [], None, 0, 0
                for a, e, _ in pieces if name in ("markdown", "md") else ():
                    first = text[a:e].split("\n", 1)[0].strip()
                    head = first if _HEADING.match(first) else head
                    heads.append(head)
                for n, (a, e, how) in enumerate(pieces):
                    line, at = line + text.count("\n", at, a), max(at, a)
                    more = describe(name, text[a:e], how, a, line, language, heads[n] if heads else None, c.strategy)
                    before, after = contexts(name, text, c, pieces, n, heads)
                    more |= {k: v for k, v in (("context_before", before), ("context_after", after)) if v}
                    part = text[a:e]
                    if c.overlap_in_content:
                        gap = "\n" if name in ("markdown", "md", "code", "source") else " "
                        part = gap.join(x for x in (before.rstrip("\n") if gap == "\n" else before, part, after) if x)
                    out.append((i, n, part, a, e, name, list(more.items())))
            types = (b.schema.field("id").type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], x) for k, x in enumerate(types)], names=["id", "n", "content", "start_index", "end_index", "chunk_type", "metadata"])

    return rows.mapInArrow(run, f"id {kind}, n int, content string, start_index bigint, end_index bigint, chunk_type string, metadata map<string,string>")


def described(texts: DataFrame, chunk_type: str = "document") -> DataFrame:
    """``(id, metadata)`` of whole texts from ``(id, text)`` as one piece each; blank ones give none."""
    kind = dict(texts.dtypes)["id"]

    def run(batches):
        for b in batches:
            meta = [list(describe(chunk_type, t, "whole").items()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(meta, pa.map_(pa.string(), pa.string()))], names=["id", "metadata"])

    rows = texts.select("id", "text").filter("text IS NOT NULL AND trim(text) <> ''")
    return rows.mapInArrow(run, f"id {kind}, metadata map<string,string>")
