"""Problem 5: markup residue in texts, found and rendered to clean text.

`detect` names the languages (html, markdown, wiki, latex) of which a text holds
a construct. `render` turns them into text. HTML always goes through a tree with
implied end tags and visibility rules: a text that is HTML as a whole is laid out
from it, with the spacing between blocks, lists and aligned cells; in a text that
holds HTML among other markup the text between elements keeps its lines, and
elements that make blocks of their own are laid out in place. Code and formulas
of the other languages stand aside meanwhile. Those are rendered through their
block and inline constructs. Text without markup is left as it is, character by
character.

Nothing recurses and no pattern is repeated a fixed number of times, so depth and
length have no limit; only the indentation of quotes and lists stops growing at
`DEEPEST` characters, their text goes on.
"""

from __future__ import annotations

from collections import Counter
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Names of HTML elements.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
INLINE = set("a abbr acronym applet area audio b base basefont bdi bdo big br button canvas caption cite code col colgroup data datalist del dfn em embed font frame i iframe img input ins kbd label link map mark meta meter noframes noscript object output param picture progress q rp rt ruby s samp script search select slot small source span strike strong style sub sup svg template textarea time track tt u var video wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style head template noscript datalist".split())
#: Elements that an opening tag ends if they are open.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
}
ENDS_P = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "body", "head", "html"}
#: LaTeX commands that stand without an argument.
BARE = "item|maketitle|tableofcontents|centering|noindent|newpage|clearpage|hline|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|sigma|phi|pi|omega|sum|prod|int|log|ln|exp|cos|sin|max|min|leq|geq|neq|approx|times|cdot|cdots|ldots|dots|infty|partial|nabla|top|lVert|rVert|in|subset|cup|cap|rightarrow|leftarrow|to|quad|qquad|bigskip|medskip|smallskip|LaTeX|TeX"

#: Characters of indentation beyond which deeper quotes and lists add none.
DEEPEST = 200

_TAG = regex.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)(/?)>")
_ENTITY = regex.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
_COMMENT = regex.compile(r"<!--.*?-->|<!DOCTYPE\s[^>]*>", regex.S | regex.I)
_FENCE = regex.compile(r"(?m)^ {0,3}(?:>\s?)*(```+|~~~+)[ \t]*[\w+-]*[ \t]*\n(?s:.*?)(?:^ {0,3}(?:>\s?)*\1[`~]*[ \t]*$|\Z)")
_TICK = regex.compile(r"(?<!`)`(?!`)[^`\n]+(?<!`)`(?!`)|(?<!`)``(?!`)(?:(?!''|``)[^\n])+``(?!`)")
_MD = [
    regex.compile(r"(?m)^ {0,3}#{1,6}[ \t]+\S"),
    regex.compile(r"(?m)^(?![-=|>#+ \t]|\d+[.)] )[^\n|]*\S[^\n|]*\n {0,3}(?:={3,}|-{3,})[ \t]*$"),
    regex.compile(r"(?<![a-zA-Z0-9*\\])\*\*(?=[^\s*])[^\n]*?[^\s*\\]\*\*(?![a-zA-Z0-9*])|(?<![\w\\])__(?=[^\s_])(?![A-Z]+__)[^\n]*?[^\s_\\]__(?!\w)"),
    regex.compile(r"(?<![a-zA-Z0-9*\\)\]])\*(?=[^\s*/])[^\n*]*?[^\s*\\]\*(?![a-zA-Z0-9*])|(?<![\w\\])_(?=[^\s_])[^\n_]*?(?:\w+_\w+[^\n_]*?)*[^\s_\\]_(?!\w)"),
    regex.compile(r"~~(?=[^\s~])[^\n]*?[^\s~]~~"),
    regex.compile(r"!?\[[^\]\n]*\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+[\"'][^\n]*?[\"'])?\)|\[[^\]\n]+\]\[[^\]\n]*\](?=\W|$)|(?m:^ {0,3}\[[^\]\n]+\]:\s+\S)|<https?://[^>\s]+>"),
    regex.compile(r"(?m)^ {0,3}>[ \t]+\S"),
    regex.compile(r"(?m)^[^\n]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|[ \t]*$"),
    regex.compile(r"\[\^[^\]\s]+\]"),
]
_WIKI = [
    regex.compile(r"\{\{[^\W\d_#{}][^{}\n]*\}\}"),
    regex.compile(r"\[\[(?![\d\s,.\]-]*\]\])[^\[\]\n\s][^\[\]\n]*\]\]"),
    regex.compile(r"(?m)^(={2,6})[ \t]*[^=\n]*[^=\s][^=\n]*\1[ \t]*$"),
    regex.compile(r"(?<!['\w])'''?(?=[^\s'])(?:(?!``|'')[^\n])+[^\s']'''?(?!['\w])|(?<=[^\x00-\x7f])'''?(?=[^\s'])(?:(?!``|'')[^\n])+[^\s']'''?"),
    regex.compile(r"(?m)^\{\|[^\n]*|^\|\}[ \t]*$|^\|-+[ \t]*$"),
    regex.compile(r"(?i)<(?:ref|nowiki|references)\b[^<>]*>"),
]
_LATEX = [
    regex.compile(r"(?<![\w:\\])\\(?:begin|end)\s*\{[a-zA-Z]+\*?\}"),
    regex.compile(r"(?<![:\\])\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{|\{\\(?:it|bf|em|tt|sc|sl|rm|sf)\b"),
    regex.compile(rf"(?<![a-zA-Z0-9:\\])\\(?:{BARE})(?![a-zA-Z_\\])"),
    regex.compile(r"\\\[(?s:.+?)\\\]|\\\((?s:.+?)\\\)|\$\$(?s:[^$]+)\$\$"),
]
_DOLLAR = regex.compile(r"(?<![\w$\\])\$(?=[^\s$])([^$\n]+?)(?<=[^\s\\])\$(?![\w$])")
_CODE_LINE = regex.compile(
    r"^\s*(?:(?:def|for|while|class|fn|struct|enum|impl|mod|use|import|from|let|const|var|return|assert|if|elif|else|try|except|with|func|package|public|private|protected|static|void|int|select|update|insert|delete|create|alter|drop|where|group by|order by|having|set|pub)\b.*(?:[;:{}(),\]]|\d|\w)"
    r"|#\[.*\]|//.*|/\*.*|\*/|--\s.*|#!.*|#include.*|@\w+.*|\s+#\s.*|[}\])]+[;,]?|[\w.:\[\]\"]+\s*(?:[+*/-]?=|:=)\s*\S.*|(?:-\s+)?[\w.:-]+:(?:\s+\S.*)?|[\w.:]+\(.*\)[;,]?|Some\(.*\)|.*[;{]\s*)$"
)
#: A label before a sentence with inline markup is no line of code.
_LABEL = regex.compile(r"^\s*(?:[-*]\s+)?[\w .-]+:\s+\S")
_MARKED = regex.compile(r"\*\*[^\s*][^*\n]*\*\*|\]\([^)\s]+\)|(?<!`)`[^`\n]+`(?!`)")
_PROSE_LINE = regex.compile(r"^[^\W\d_][^\n]*\s[^\n]*[.!?:;,]?$")


def is_code(text: str) -> bool:
    """Whether nearly all lines are program code or its comments."""
    lines = [x for x in _ENTITY.sub("x", text).split("\n") if x.strip()]
    if not lines:
        return False
    code = sum(1 for x in lines if _CODE_LINE.match(x) and not (_LABEL.match(x) and _MARKED.search(x)))
    return code >= 0.7 * len(lines)


def _is_math(inner: str) -> bool:
    if regex.search(r"\\[a-zA-Z]|[\^_{}]", inner) or (len(inner) <= 2 and inner.isalpha()):
        return True
    return bool(regex.fullmatch(r"[\w\s+\-*/=<>().,|']+", inner)) and bool(regex.search(r"[=+<>/*]", inner)) and not regex.match(r"\d+(?:[.,]\d+)*\s", inner)


def _has_html(text: str) -> bool:
    if "<" in text:
        if "<!" in text and _COMMENT.search(text):
            return True
        for m in _TAG.finditer(text):
            name = m.group(2).lower()
            if name not in BLOCK and name not in INLINE:
                continue
            before = text[m.start() - 1 : m.start()]
            # A name right after a word may be a type parameter, unless the element is closed somewhere.
            if before and (before.isascii() and (before.isalnum() or before in "_:&")) and not m.group(1) and name not in VOID and f"</{name}" not in text.lower():
                continue
            return True
    if "&" in text:
        for m in _ENTITY.finditer(text):
            if m.group(1)[0] == "#" or m.group(1) + ";" in html5:
                return True
    return False


#: Signs of which a text must hold one for a pattern to be tried, in the patterns' order.
_MD_SIGNS = (("#",), ("---", "==="), ("**", "__"), ("*", "_"), ("~~",), ("](", "][", "]:", "<http"), (">",), ("--",), ("[^",))
_WIKI_SIGNS = (("{{",), ("[[",), ("==",), ("''",), ("{|", "|}", "|-"), ("<",))


def _any(patterns, signs, text: str) -> bool:
    return any(p.search(text) for p, needed in zip(patterns, signs) if any(x in text for x in needed))


def detect(text: str | None) -> list[str]:
    """The markup languages of which `text` holds a construct, in alphabetical order."""
    if not text or not regex.search(r"[<&#*_~`\[>|{'=\\$-]", text):
        return []
    found = []
    bare = text
    markdown = False
    if ("```" in text or "~~~" in text) and _FENCE.search(bare):
        markdown, bare = True, _FENCE.sub("\n", bare)
    if "`" in bare and _TICK.search(bare):
        markdown, bare = True, _TICK.sub("x", bare)
    if _has_html(bare):
        found.append("html")
    plain = regex.sub(r"(?is)<(pre|code|script|style)\b[^>]*>.*?</\1\s*>", " ", bare) if "<" in bare else bare
    plain = regex.sub(r"(?s)<!--.*?-->", " ", plain)
    latex = any(p.search(plain) for p in _LATEX) if "\\" in plain or "$$" in plain else False
    if not latex and "$" in plain:
        latex = any(_is_math(m.group(1)) for m in _DOLLAR.finditer(plain))
    if latex:
        found.append("latex")
    # Formulas and LaTeX verbatim hold signs that mean nothing elsewhere.
    rest = _DOLLAR.sub(lambda m: "x" if _is_math(m.group(1)) else m.group(0), plain) if "$" in plain else plain
    rest = regex.sub(r"(?s)\\begin\{(verbatim|lstlisting|equation|align|tabular|math)\*?\}.*?\\end\{\1\*?\}|\\\[.*?\\\]|\\\(.*?\\\)", " ", rest) if latex else rest
    rest = regex.sub(r"https?://[^\s)\]>|]+", "u", rest) if "://" in rest else rest
    if markdown or _any(_MD, _MD_SIGNS, rest):
        found.append("markdown")
    if _any(_WIKI, _WIKI_SIGNS, rest):
        found.append("wiki")
    # Program code and its comments hold signs that look like markup.
    if found and "</" not in text and is_code(text) and not _FENCE.search(text):
        return []
    return found


# Rendering ---------------------------------------------------------------------------------------


def table(rows: list[list[str]]) -> str:
    """Rows of cells with the columns aligned."""
    width = max(map(len, rows))
    rows = [[" ".join(c.split()) for c in r] + [""] * (width - len(r)) for r in rows]
    wide = [max(len(r[k]) for r in rows) for k in range(width)]
    return "\n".join(" | ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in rows)


class _Tree(HTMLParser):
    """A tree of ``[name, attributes, children]`` with end tags implied where they are left out."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]
        self.names: Counter = Counter()
        # Elements of raw text and hidden ones need an end tag to be such, or they would take all that follows.
        low = text.lower()
        self.ends = {n: low.count("</" + n) for n in (*self.CDATA_CONTENT_ELEMENTS, *getattr(self, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext", *HIDDEN)}
        self.feed(text)
        # What is left at the end is an unfinished tag, which some versions of the parser drop: text.
        rest, into = self.rawdata, self.open[-1][2]
        before = len(into)
        self.close()
        if rest and rest not in "".join(k for k in into[before:] if isinstance(k, str)):
            self.handle_data(rest)

    def set_cdata_mode(self, elem, **kw):
        if self.ends.get(elem, 0) > 0:
            super().set_cdata_mode(elem, **kw)

    def cut(self, place: int) -> None:
        for node in self.open[place:]:
            self.names[node[0]] -= 1
        del self.open[place:]

    def close_to(self, names: set[str], stop: set[str], outermost: bool = False) -> None:
        """End the innermost open element of these names, or with `outermost` all within the nearest of `stop`."""
        if not any(self.names[n] > 0 for n in names):
            return
        place = 0
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in stop:
                break
            if self.open[k][0] in names:
                place = k
                if not outermost:
                    break
        if place:
            self.cut(place)

    def handle_starttag(self, tag, attrs):
        if tag not in BLOCK and tag not in INLINE:
            self.handle_data(self.get_starttag_text() or "")
            return
        if tag in HIDDEN and tag != "head" and self.ends[tag] <= 0:
            self.handle_data(self.get_starttag_text() or "")
            return
        if tag in CLOSED_BY:
            self.close_to(CLOSED_BY[tag], {"ul", "ol", "dl", "table", "select"}, True)
        if tag in ENDS_P:
            self.close_to({"p"}, BLOCK - {"p"})
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1][0] == tag:
            self.cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in self.ends:
            self.ends[tag] -= 1
        if tag in BLOCK or tag in INLINE:
            self.close_to({tag}, set())
        else:
            self.handle_data(f"</{tag}>")

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _hidden(node) -> bool:
    name, attrs, _ = node
    style = (attrs.get("style") or "").replace(" ", "").lower()
    return name in HIDDEN or "hidden" in attrs or "display:none" in style or "visibility:hidden" in style


def _squeeze(text: str) -> str:
    return "\n".join(" ".join(x.split()) for x in text.split("\n")).strip()


class _Writer:
    """Lines of blocks within nested containers, each with what stands before its lines and between its blocks."""

    def __init__(self, between: str = "\n\n"):
        self.parts: list[str] = []
        # before the first line, before others, between blocks
        self.stack: list[tuple[str, str, str]] = [("", "", between)]
        self.used = 0  # so many of the containers hold something already

    def enter(self, first: str, rest: str, between: str) -> None:
        a, b, _ = self.stack[-1]
        lead = b if self.used == len(self.stack) else a
        self.stack.append((lead + first, b + (rest if len(b) < DEEPEST else ""), between) if len(lead) < DEEPEST else (lead, b, between))

    def leave(self) -> None:
        self.stack.pop()
        self.used = min(self.used, len(self.stack))

    def block(self, text: str) -> None:
        first, rest, _ = self.stack[-1]
        if self.used:
            _, around, between = self.stack[self.used - 1]
            self.parts.append(between if between == "\n" else f"\n{around}\n")
        self.parts.append((rest if self.used == len(self.stack) else first) + text.replace("\n", "\n" + rest))
        self.used = len(self.stack)

    def text(self) -> str:
        return "".join(self.parts)


#: Elements laid out in place where HTML stands among other markup.
_LAID_OUT = {"table", "ul", "ol", "menu", "dir", "pre", "blockquote", "details", "dl"}


class _Renderer:
    """Walks a tree once, with a stack of its own."""

    def __init__(self, whole: bool):
        self.whole = whole
        self.writers = [_Writer()]
        self.line: list[str] = []
        self.verbatim: list[str] = []  # what a mixed text is made of
        self.flat = self.pre = self.code = 0
        self.tables: list[list[list[str]]] = []
        self.numbers: list[int | None] = []
        self.laid = 0

    def flush(self) -> None:
        """The inline text so far as blocks; a blank line of the source divides them too."""
        text = "".join(self.line)
        self.line.clear()
        for b in regex.split(r"\n[ \t]*\n", text):
            if b := _squeeze(b):
                self.writers[-1].block(b)

    def run(self, root) -> str:
        todo: list = [("walk", root)]
        while todo:
            what, x = todo.pop()
            if what == "walk":
                after = self.enter(x)
                if after is None:
                    continue
                if after:
                    todo.append(("after", after))
                todo.extend(("text", k) if isinstance(k, str) else ("walk", k) for k in reversed(x[2]))
            elif what == "text":
                (self.line if self.whole or self.laid else self.verbatim).append(x)
            else:
                x()
        if not self.whole:
            return "".join(self.verbatim)
        self.flush()
        return self.writers[0].text()

    def enter(self, node):
        """What to do after the children; None to leave them out, an empty string for nothing."""
        name, attrs, kids = node
        if name and _hidden(node):
            return None
        if not self.whole and not self.laid:
            return self.enter_mixed(name, attrs)
        if name == "br":
            self.line.append("\n")
            return None
        if name == "img":
            self.line.append(attrs.get("alt") or "")
            return None
        if name in ("code", "kbd", "samp", "tt") and not self.pre:
            return self.enter_code()
        if name not in BLOCK or self.flat or self.pre:
            return ""
        if name == "table":
            return self.enter_table()
        self.flush()
        if name[0] == "h" and name[1:].isdigit():
            return self.enter_flat(lambda t: self.writers[-1].block("#" * int(name[1]) + " " + t.replace("\n", " ")))
        if name == "pre":
            self.pre += 1
            return self.end_pre
        if name in ("ul", "ol", "menu", "dir"):
            self.numbers.append(1 if name == "ol" else None)
            self.writers[-1].enter("", "", "\n")
            return self.end_list
        if name == "li":
            number = self.numbers[-1] if self.numbers else None
            mark = "- " if number is None else f"{number}. "
            if number is not None:
                self.numbers[-1] += 1
            self.writers[-1].enter(mark, " " * len(mark), "\n")
            return self.end_container
        if name == "blockquote":
            self.writers[-1].enter("> ", "> ", "\n\n")
            return self.end_container
        if name == "hr":
            self.writers[-1].block("---")
            return None
        if name == "tr" and self.tables:
            self.tables[-1].append([])
            return self.flush
        if name in ("td", "th") and self.tables:
            self.writers.append(_Writer("\n"))
            return self.end_cell
        return self.flush

    def enter_mixed(self, name: str, attrs: dict):
        if name in _LAID_OUT:
            self.laid += 1
            self.writers.append(_Writer())
            self.verbatim.append("\n")
            after = self.enter([name, attrs, []])

            def done():
                if callable(after):
                    after()
                self.flush()
                self.verbatim.append(self.writers.pop().text() + "\n")
                self.laid -= 1

            return done
        if name == "img":
            self.verbatim.append(attrs.get("alt") or "")
            return None
        if name in ("br", "hr", "p", "div", "li", "tr") or name[:1] == "h" and name[1:].isdigit():
            self.verbatim.append("\n")
            return None if name in VOID else lambda: self.verbatim.append("\n")
        return ""

    def enter_code(self):
        self.code += 1
        if self.code > 1:
            return self.leave_code
        start = len(self.line)

        def done():
            self.code -= 1
            text = "".join(self.line[start:])
            self.line[start:] = [f"`{text}`" if text.strip() else text]

        return done

    def leave_code(self) -> None:
        self.code -= 1

    def enter_flat(self, emit):
        self.flat += 1

        def done():
            self.flat -= 1
            text = _squeeze("".join(self.line))
            self.line.clear()
            if text:
                emit(text)

        return done

    def end_pre(self) -> None:
        self.pre -= 1
        text = "".join(self.line).strip("\n")
        self.line.clear()
        self.writers[-1].block("```\n" + text + "\n```")

    def end_container(self) -> None:
        self.flush()
        self.writers[-1].leave()

    def end_list(self) -> None:
        self.numbers.pop()
        self.end_container()

    def enter_table(self):
        self.flush()
        self.tables.append([])
        return self.end_table

    def end_table(self) -> None:
        self.flush()
        rows = [r for r in self.tables.pop() if r]
        if rows:
            self.writers[-1].block(table(rows))

    def end_cell(self) -> None:
        self.flush()
        cell = " ".join(self.writers.pop().text().split())
        if not self.tables[-1]:
            self.tables[-1].append([])
        self.tables[-1][-1].append(cell)


def render_html(text: str) -> str:
    """A text that is HTML as a whole."""
    return _Renderer(True).run(_Tree(text).root)


def resolve_html(text: str) -> str:
    """A text with HTML among other markup, whose lines stay."""
    return _Renderer(False).run(_Tree(text).root)


def templates(text: str) -> str:
    """``{{name|a|key=b}}`` resolved to its values, at any depth in one pass; unfinished ones stay."""
    stack: list[list[str]] = [[]]
    at = 0
    for m in regex.finditer(r"\{\{|\}\}", text):
        stack[-1].append(text[at : m.start()])
        at = m.end()
        if m.group() == "{{":
            stack.append([])
        elif len(stack) == 1:
            stack[-1].append("}}")
        else:
            values = "".join(stack.pop()).split("|")[1:]
            stack[-1].append(" ".join(v.split("=")[-1].strip() for v in values if v.strip()))
    stack[-1].append(text[at:])
    out = "".join(stack[0])
    return out + "".join("{{" + "".join(x) for x in stack[1:])


def unwrap(text: str) -> str:
    """LaTeX commands with an argument resolved to it, at any depth in one pass; unfinished ones stay."""
    stack: list[tuple[str, list[str]]] = [("", [])]
    at = 0
    for m in regex.finditer(r"\\[\\{}]|\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|[{}]", text):
        found = m.group()
        stack[-1][1].append(text[at : m.start()])
        at = m.end()
        if found[0] == "\\" and len(found) == 2:
            stack[-1][1].append(found)
        elif found != "}":
            stack.append((found, []))
        elif len(stack) == 1:
            stack[-1][1].append("}")
        else:
            opened, inner = stack.pop()
            stack[-1][1].append("".join(inner) if opened != "{" else "{" + "".join(inner) + "}")
    stack[-1][1].append(text[at:])
    return "".join(opened + "".join(inner) for opened, inner in stack)


def _inline_markdown(t: str) -> str:
    t = regex.sub(r"!\[([^\]\n]*)\]\([^)\n]*\)", r"\1", t)
    t = regex.sub(r"(?<!\[)\[([^\]\[\n]+)\]\([^)\n]*\)", r"\1", t)
    t = regex.sub(r"\[([^\]\[\n^]+)\]\[[^\]\n]*\]", r"\1", t)
    t = regex.sub(r"<(https?://[^>\s]+)>", r"\1", t)
    t = regex.sub(r"~~(?=\S)(.*?\S)~~", r"\1", t)
    t = regex.sub(r"(?<![a-zA-Z0-9*\\])(\*\*\*?)(?=[^\s*])(.*?[^\s*\\])\1(?![a-zA-Z0-9*])", r"\2", t)
    t = regex.sub(r"(?<![\w\\])__(?=[^\s_])(.*?[^\s_\\])__(?!\w)", r"\1", t)
    t = regex.sub(r"(?<![a-zA-Z0-9*\\])\*(?=[^\s*])([^\n*]*?[^\s*\\])\*(?![a-zA-Z0-9*])", r"\1", t)
    t = regex.sub(r"(?<![\w\\])_(?=[^\s_])([^\n]*?[^\s_\\])_(?!\w)", r"\1", t)
    return regex.sub(r"\\([*_`~\[\]#|>\\])", r"\1", t)


def render_markdown(text: str) -> str:
    out, lines, k = [], text.split("\n"), 0
    while k < len(lines):
        line = lines[k]
        fence = regex.match(r"\s{0,3}(```+|~~~+)", line)
        if fence:
            mark, body = fence.group(1)[0] * 3, []
            k += 1
            while k < len(lines) and not lines[k].lstrip().startswith(mark):
                body.append(lines[k])
                k += 1
            out += ["```", *body, "```"]
        elif k + 1 < len(lines) and line.strip() and regex.fullmatch(r"\s{0,3}(=+|-{2,})\s*", lines[k + 1]) and not regex.match(r"\s*([-*+>|#]|\d+[.)])\s", line):
            out.append(("# " if "=" in lines[k + 1] else "## ") + _inline_markdown(line.strip()))
            k += 1
        elif regex.match(r"\s*\|?[^|\n]*\|", line) and k + 1 < len(lines) and regex.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", lines[k + 1]):
            rows = [line]
            k += 1
            while k + 1 < len(lines) and "|" in lines[k + 1]:
                k += 1
                rows.append(lines[k])
            out.append(table([[_inline_markdown(c.strip()) for c in regex.split(r"(?<!\\)\|", r.strip().removeprefix("|").removesuffix("|"))] for r in rows]))
        elif m := regex.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            out.append(m.group(1) + " " + _inline_markdown(m.group(2)))
        else:
            # Code marks are kept as they are, what stands between them is rendered.
            out.append("".join(p if p[:1] == "`" else _inline_markdown(p) for p in regex.split(r"(`+[^`]+`+)", line) if p))
        k += 1
    return "\n".join(out)


def render_wiki(text: str) -> str:
    text = regex.sub(r"(?s)<ref\b[^>/]*>.*?</ref>|<ref\b[^>]*/>|<references\s*/?>", "", text)
    text = regex.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría|Категория|File|Image|Datei)\s*:[^\[\]]*\]\]", "", text, flags=regex.I)
    text = regex.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", text)
    text = templates(text)
    text = regex.sub(r"\[(https?://\S+)\s+([^\]\n]+)\]", r"\2", text)
    text = regex.sub(r"'''(?=\S)(.+?)'''", r"\1", text)
    text = regex.sub(r"''(?=\S)(.+?)''", r"\1", text)
    text = regex.sub(r"(?m)^(={1,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m.group(1)) + " " + m.group(2), text)

    def grid(m):
        rows, row = [], []
        for line in m.group(0).split("\n")[1:]:
            line = line.strip()
            if line.startswith(("|-", "|}")):
                if row:
                    rows.append(row)
                row = []
            elif line.startswith(("|+",)):
                rows.append([line[2:].strip()])
            elif line[:1] in "|!" and line:
                row += [regex.sub(r'^\s*\w+="[^"]*"\s*\|', "", c).strip() for c in regex.split(r"\|\||!!", line[1:])]
        return table(rows + ([row] if row else [])) if rows or row else ""

    text = regex.sub(r"(?ms)^\{\|.*?^\|\}[ \t]*$", grid, text)
    return regex.sub(r"(?m)^([*#]+)[ \t]*(?=\S)", lambda m: "  " * (len(m.group(1)) - 1) + ("- " if m.group(1)[-1] == "*" else "1. ") if not (m.group(1)[0] == "#" and m.end() < len(text) and m.group(0).endswith(" ")) else m.group(0), text)


def render_latex(text: str) -> str:
    kept: list[str] = []

    def keep(m):
        kept.append(m.group(0))
        return f"\x00{len(kept) - 1}\x00"

    text = regex.sub(r"(?s)\\begin\{(verbatim|lstlisting)\}(?:\[[^\]]*\])?\n?(.*?)\n?\\end\{\1\}", lambda m: "```\n" + m.group(2) + "\n```", text)
    text = regex.sub(r"(?s)```\n.*?\n```", keep, text)
    text = regex.sub(r"(?s)\\begin\{(equation|align|math|displaymath)\*?\}\s*(.*?)\s*\\end\{\1\*?\}", lambda m: "$$" + m.group(2) + "$$", text)
    text = regex.sub(r"(?s)\\\[\s*(.+?)\s*\\\]", r"$$\1$$", text)
    text = regex.sub(r"(?s)\\\((.+?)\\\)", r"$\1$", text)
    text = regex.sub(r"(?s)\$\$.+?\$\$", keep, text)
    text = _DOLLAR.sub(lambda m: keep(m) if _is_math(m.group(1)) else m.group(0), text)
    text = regex.sub(r"(?m)(?<!\\)%.*$", "", text)
    for name, mark in (("chapter", "#"), ("section", "##"), ("subsection", "###"), ("subsubsection", "####"), ("paragraph", "#####")):
        text = regex.sub(rf"\\{name}\*?\{{([^{{}}]*)\}}", rf"\n\n{mark} \1\n\n", text)

    def grid(m):
        rows = [[c.strip() for c in regex.split(r"(?<!\\)&", r)] for r in regex.split(r"\\\\", regex.sub(r"\\(?:hline|toprule|midrule|bottomrule)", "", m.group(1))) if r.strip()]
        return "\n" + table(rows) + "\n" if rows else ""

    text = regex.sub(r"(?s)\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)\\end\{tabular\}", grid, text)
    text = regex.sub(r"(?m)^[ \t]*\\item(?:\[([^\]]*)\])?[ \t]*", lambda m: "- " + (m.group(1) + " " if m.group(1) else ""), text)
    text = regex.sub(r"\\item\b[ \t]*", "\n- ", text)
    text = regex.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?\n?", "", text)
    text = regex.sub(r"\\(?:label|cite|ref|eqref|pageref|usepackage|documentclass)(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
    text = regex.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
    text = regex.sub(r"\\texttt\{([^{}]*)\}", r"`\1`", text)
    text = unwrap(text)
    text = regex.sub(r"(?<![\w:\\])\\(?:it|bf|tt|em|maketitle|tableofcontents|centering|noindent|newpage|clearpage|hline|bigskip|medskip|smallskip)\b[ \t]*", "", text)
    text = regex.sub(r"\\([&%$#_{}])", r"\1", text).replace("``", "“").replace("''", "”")
    text = regex.sub(r"\\\\[ \t]*$", "", text, flags=regex.M)
    # A piece that was set aside may hold earlier ones only.
    for k in range(len(kept)):
        kept[k] = regex.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], kept[k])
    return regex.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], text)


_ASIDE = regex.compile(r"(?m)^ {0,3}(?:```|~~~)[^\n]*\n(?s:.*?)(?:^ {0,3}(?:```|~~~)[ \t]*$|\Z)|`[^`\n]+`")
_FORMULA = regex.compile(r"(?s)\\\[.+?\\\]|\\\(.+?\\\)|\$\$[^$]+\$\$|\\begin\{(verbatim|lstlisting|equation|align|math|displaymath)\*?\}.*?\\end\{\1\*?\}")


def render(text: str | None, languages: list[str] | None = None) -> str | None:
    """Clean text of a text with markup; any other text, and null, as it is."""
    if text is None:
        return None
    languages = detect(text) if languages is None else languages
    if not languages:
        return text
    if "html" in languages:
        if text.count("</") >= 2 and text.lstrip().startswith("<"):
            text = render_html(text)
        else:
            # Code and formulas of the other languages stand aside.
            mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text)
            aside: list[str] = []

            def put(m):
                aside.append(m.group(0))
                return f"{mark}{len(aside) - 1}{mark}"

            kept = _ASIDE.sub(put, text)
            if "latex" in languages:
                kept = _FORMULA.sub(put, kept)
                kept = _DOLLAR.sub(lambda m: put(m) if _is_math(m.group(1)) else m.group(0), kept)
            text = resolve_html(kept)
            for k in range(len(aside)):
                aside[k] = regex.sub(f"{mark}(\\d+){mark}", lambda m: aside[int(m.group(1))], aside[k])
            text = regex.sub(f"{mark}(\\d+){mark}", lambda m: aside[int(m.group(1))], text)
    if "latex" in languages:
        text = render_latex(text)
    if "wiki" in languages:
        text = render_wiki(text)
    if "markdown" in languages:
        text = render_markdown(text)
    return regex.sub(r"\n{3,}", "\n\n", text).strip("\n")


def clean(chunks: DataFrame) -> DataFrame:
    """``(id, markup, clean)`` from ``(id, text)``: the languages found, and the rendered text.

    A null text gives no language and null; a text without markup is given
    unchanged. Nothing is shuffled; texts are read whole.
    """

    def run(batches):
        for b in batches:
            found, out = [], []
            for t in b.column("text").to_pylist():
                f = detect(t)
                found.append(f)
                out.append(render(t, f))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.list_(pa.string())), pa.array(out, pa.string())], names=["id", "markup", "clean"])

    return chunks.select("id", "text").mapInArrow(run, "id string, markup array<string>, clean string")
