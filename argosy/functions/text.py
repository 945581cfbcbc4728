"""Text of Markdown documents: lines, links, citations, markers, headings, terms, sentences, and their Arrow UDFs.

Rules follow Python's own text semantics (splitlines, \\w, str.split white space). Every function here is pure Python over one text;
the `*_of` functions apply them to a table (path, text) in Arrow batches.
"""

from __future__ import annotations

import functools
import itertools
import posixpath
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Link, definition, marker, markup and maths patterns.
LINK = re.compile(r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(\s*(<[^>]*>|[^)\s]+)(?:\s+(\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
REFERENCE = re.compile(r"(?m)^[ \t]{0,3}\[[^\[\]^][^\[\]]*\]:[ \t]*(<[^>]*>|\S+)[ \t]*(?:\"[^\"]*\"|'[^']*'|\([^)]*\))?[ \t]*$")
#: What a statement marker's comment opens with, before its ids; a parameter wherever markers are read or written.
PREFIX = "node-id"
ID_TOKEN = re.compile(r"\b(?:clm|exp|ana|wrk|axm)-[a-z0-9]{6}\b")
MARKUP, PLAIN_LINK = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>"), re.compile(r"\[([^\[\]]*)\]\([^()]*\)")
GONE = "\uffff"  # no character
WORDS = regex.compile(r"[\p{L}\p{N}](?:\uffff*[\p{L}\p{N}])*")
MATHS = re.compile(r"\$`[^`]*`\$")
FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[ \t]*(.*?)[ \t]*$")
QUOTE = re.compile(r"^(?:[ \t]{0,3}>[ \t]?)+")
HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*$")
SYMBOL = re.compile(r"\\[A-Za-z]+(?:_\{[^{}]*\}|_[A-Za-z0-9])?|[A-Za-z](?:_\{[^{}]*\}|_[A-Za-z0-9])")
STOP = re.compile("[.!?][\"')\\]*_`»”’]* ")
INITIAL = re.compile(r"[A-Za-z]\.")
OPENS = re.compile("[A-Z0-9$\\\\`*_(\\[\"'#—-]")
# Words too common to tell statements apart, and tokens with a stop that ends no sentence.
STOPWORDS = frozenset(
    """the and for that this with from are is be as by of to in on at or an it its not no which when where then than these those their
    there such can may must will would into under over between each every both only also more most any all one two has have had was
    were been being what how why who whom our we us but if so do does done per via text mathrm frac left right cdot quad mathbb begin
    end href data reference type class span id label eqref ref qquad operatorname displaystyle""".split()
)
ABBREVIATIONS = frozenset(
    """al. app. approx. cf. ch. cor. def. dr. e.g. ed. eds. eq. eqn. eqns. eqs. etc. fig. figs. i.e. incl. lem. max. min. mr. mrs. ms. no.
    p. pp. prof. prop. ref. refs. resp. sec. sect. secs. st. thm. trans. viz. vol. vols. vs.""".split()
)


def normal_space(text: str) -> str:
    return " ".join(text.split())


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def blank_inline(text: str) -> str:
    """Inline maths and code spans as spaces; a run of n backticks closes at the next run of exactly n on its line."""
    text = MATHS.sub(lambda m: _blank(m[0]), text)
    runs = [m.span() for m in re.finditer("`+", text)]
    closes, later = {}, {}
    for a, b in reversed(runs):
        closes[a], later[b - a] = later.get(b - a), (a, b)
    spans, at = [], 0
    for a, b in runs:
        close = closes[a]
        if a >= at and close and "\n" not in text[b : close[0]]:
            spans.append((a, close[1]))
            at = close[1]
    return "".join(part for (_, end), (a, b) in itertools.pairwise([(0, 0), *spans, (len(text), len(text))]) for part in (text[end:a], _blank(text[a:b])))


def fences(lines: list[str]) -> list[tuple[int, int, str]]:
    """First line, line after, info of every fenced block; one left open runs to the end, a quoted one ends with its quote."""
    out, start, mark, info, quoted = [], -1, "", "", False
    for i, raw in enumerate(lines):
        prefix = (QUOTE.match(raw) or re.match("", raw))[0]
        m = FENCE.match(raw[len(prefix) :])
        if start < 0:
            if m:
                start, mark, info, quoted = i, m[1], m[2], bool(prefix)
        elif quoted and not prefix:
            out.append((start, i, info))
            start = -1
        elif m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2]:
            out.append((start, i + 1, info))
            start = -1
    return [*out, (start, len(lines), info)] if start >= 0 else out


def strip_code(text: str) -> str:
    """Fenced blocks and inline code as spaces, every line where it was."""
    lines = text.splitlines()
    for a, b, _ in fences(lines):
        lines[a:b] = [_blank(x) for x in lines[a:b]]
    return blank_inline("\n".join(lines))


def links(line: str) -> list[tuple[str, str, str, int, int]]:
    """Text, destination, title, start, end of every inline link."""
    return [(m[1], m[2], m[3][1:-1] if m[3] else "", m.start(), m.end()) for m in LINK.finditer(line)]


def closing(text: str) -> tuple[str, str]:
    """The text up to its last comment's close, and the rest: a comment that opens in the first part is closed there, so patterns of comments take linear time on it; none lies in the rest."""
    cut = text.rfind("-->") + 3
    return (text[:cut], text[cut:]) if cut > 2 else ("", text)


@functools.cache
def marker(prefix: str = PREFIX) -> re.Pattern:
    """The pattern of statement markers, for the first part of `closing`."""
    return re.compile(rf"(?s)<!--\s*{re.escape(prefix)}:(.*?)-->")


def without_markers(text: str, prefix: str = PREFIX) -> str:
    head, rest = closing(text)
    return marker(prefix).sub("", head) + rest


def markers(text: str, prefix: str = PREFIX) -> list[tuple[str, int, int]]:
    """Id, line (from 0), offset of every statement marker; works and axioms are hosted nowhere. An id of more than six characters is read whole."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    return [(i, bisect_left(breaks, m.start()), m.start()) for m in marker(prefix).finditer(closing(text)[0]) for i in re.findall(r"(?:clm|exp|ana)-[a-z0-9]{6,}", m[1])]


def bare_ids(line: str, prefix: str = PREFIX) -> list[str]:
    """Ids in prose: outside links, markers and definitions, or a link's whole text."""
    shut, defined, own = [m.span() for m in marker(prefix).finditer(closing(line)[0])], [m.span() for m in REFERENCE.finditer(line)], links(line)
    out = []
    for m in ID_TOKEN.finditer(line):
        if any((i := bisect_right(held, m.start(), key=lambda x: x[0]) - 1) >= 0 and m.end() <= held[i][1] for held in (shut, defined)):
            continue
        i = bisect_left(own, m.start(), key=lambda x: x[3]) - 1
        if i < 0 or m.start() >= own[i][4] or own[i][0] == m[0]:
            out.append(m[0])
    return out


def _comments_closed(text: str) -> str:
    """The text with the opening of every comment that its line doesn't close as other signs."""
    if "<!--" not in text:
        return text
    lines = text.split("\n")
    return "\n".join(line[: (cut := max(line.rfind("-->"), 0))] + line[cut:].replace("<!--", "<!..") for line in lines)


def words(text: str) -> list[tuple[int, bool, str]]:
    """Place, whether a wide gap (two spaces in a row) stands before it, and lower-cased form of every run of letters and numbers.

    Markup and all of a link but its text is filled up with GONE first, so that places stay and words join across it.
    """
    bare = PLAIN_LINK.sub(lambda m: GONE + m[1] + GONE * (len(m[0]) - len(m[1]) - 1), text.replace(GONE, "."))
    bare = MARKUP.sub(lambda m: GONE * len(m[0]), _comments_closed(bare))
    out, end = [], 0
    for m in WORDS.finditer(bare):
        word = m[0].replace(GONE, "")
        # By the letter: a sigma at the end stays one.
        out.append((m.start(), "  " in bare[end : m.start()], "".join(map(str.lower, word)) if "Σ" in word else word.lower()))
        end = m.end()
    return out


def canonical(text: str) -> str:
    """The words by one space, or by two over a wide gap."""
    return "".join(("  " if wide else " ") + w for _, wide, w in words(text)).lstrip(" ")


def slug(heading: str) -> str:
    """A heading's anchor: rendered text, lower case, spaces as hyphens, other signs dropped."""
    head, rest = closing(re.sub(r"[ \t]#+[ \t]*$", "", re.sub(r"^#{1,6}\s+", "", heading)))
    text = re.sub(r"(?s)<!--.*?-->", "", head) + rest
    text = LINK.sub(lambda m: m[1], re.sub(r"!(?=\[)", "", text))
    text = re.sub(r"(?<!\w)_([^_]+)_(?!\w)", r"\1", text).strip().lower()
    return "".join("-" if c == " " else c for c in text if c in " -" or unicodedata.category(c)[0] in "LMN" or unicodedata.category(c) == "Pc")


def slugs(headings: list[str]) -> list[str]:
    """Anchors of a document's headings in order; a taken one gets the first free number."""
    taken: dict[str, int] = {}  # anchor: the last number it was given
    for base in map(slug, headings):
        free = (n for n in itertools.count(taken.get(base, 0) + 1) if f"{base}-{n}" not in taken)
        if base in taken:
            taken[base] = n = next(free)
            base = f"{base}-{n}"
        taken[base] = 0
    return list(taken)


def headings(text: str) -> list[tuple[int, int, str]]:
    """Line (from 1), level, text of every heading outside code."""
    plain = strip_code(text).splitlines()
    return [(i + 1, len(m[1]), raw.lstrip("#").strip()) for i, (line, raw) in enumerate(zip(plain, text.splitlines(), strict=False)) if (m := HEADING.match(line))]


def symbols(text: str) -> list[str]:
    """Maths symbols of inline maths and of maths fences, marked m:."""
    lines = text.splitlines()
    spans = [m[0][2:-2] for m in MATHS.finditer(text)] + ["\n".join(lines[a + 1 : b - 1]) for a, b, info in fences(lines) if info == "math"]
    out = []
    for raw in (m[0] for s in spans for m in SYMBOL.finditer(s)):
        if raw.lstrip("\\").split("_")[0].lower() not in STOPWORDS:
            out.append("m:" + re.sub(r"_\{(\w)\}", r"_\1", raw.replace(" ", "")))
    return out


def terms(text: str) -> list[str]:
    """Folded words of more than two letters that aren't all digits or stop words, then maths symbols."""
    return [w for _, _, w in words(text) if len(w) > 2 and not w.isdecimal() and w not in STOPWORDS] + symbols(text)


def plain_terms(text: Column) -> Column:
    """`terms` without maths, in the JVM."""
    bare = F.regexp_replace(F.regexp_replace(F.translate(text, GONE + "Σ", ".σ"), PLAIN_LINK.pattern, f"{GONE}$1{GONE}"), "(?d)" + MARKUP.pattern, "")
    found = F.regexp_extract_all(F.replace(bare, F.lit(GONE), F.lit("")), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.filter(F.transform(found, F.lower), lambda w: (F.length(w) > 2) & ~w.rlike(r"^\p{Nd}+$") & ~w.isin(*sorted(STOPWORDS)))


def terms_of(text: Column) -> Column:
    """`terms` as a column: only texts with maths or fences are handed to Python, for their symbols, and those that open more than 100 comments, as the JVM's pattern looks for the end of each."""
    hostile = F.regexp_count(text, F.lit("<!--")) > 100
    plain = F.when(~hostile, plain_terms(F.when(~hostile, text))).otherwise(udf(lambda x: [w for w in terms(x) if not w.startswith("m:")], "array<string>")(F.when(hostile, text)))
    maths = F.when(F.contains(text, F.lit("$`")) | F.contains(text, F.lit("```")) | F.contains(text, F.lit("~~~")), text)
    return F.concat(plain, F.coalesce(udf(symbols, "array<string>")(maths), F.array().cast("array<string>")))


def _within(text: str, sign: str) -> Callable[[int], bool]:
    """Whether a place lies between an odd and an even unescaped sign."""
    marks = [m.start() for m in re.finditer(rf"(?<!\\){re.escape(sign)}", text)]
    return lambda at: bisect_left(marks, at) % 2 == 1


def sentence_ends(text: str) -> list[int]:
    """Where a sentence ends before another: at stops before a space and an opening character, outside code and maths, not after abbreviations or initials."""
    maths, code = _within(text, "$"), _within(text, "`")

    def ends(stop: re.Match) -> bool:
        token = text[text.rfind(" ", 0, stop.end() - 1) + 1 : stop.end() - 1]
        return bool(OPENS.match(text, stop.end())) and token.lower() not in ABBREVIATIONS and not INITIAL.fullmatch(token) and not maths(stop.start()) and not code(stop.start())

    return [stop.end() - 1 for stop in STOP.finditer(text) if ends(stop)]


def sentences(text: str) -> list[str]:
    """Sentences of one collapsed paragraph."""
    ends = sentence_ends(text)
    return [x for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(text)], strict=True) if (x := text[a:b])]


def resolved(source: str, target: str) -> tuple[str, str]:
    """Path and fragment that a link of a document names; "" for another scheme or a rooted path."""
    target = target.strip("<>")
    if re.match(r"(?i)^(?:[a-z][a-z0-9+.\-]*:|[/~])", target):
        return "", ""
    path, _, fragment = target.partition("#")
    path = re.sub(r":\d+$", "", unquote(path))
    return (posixpath.normpath(posixpath.join(posixpath.dirname(source), path)) if path else source), fragment


def locality(a: str, b: str) -> str:
    """document, directory, paper (top folder) or cross: how near two paths are."""
    return "document" if a == b else "directory" if posixpath.dirname(a) == posixpath.dirname(b) else "paper" if a.split("/")[0] == b.split("/")[0] else "cross"


def excerpt_lines(document: str, excerpt: str) -> list[int]:
    """Lines (from 1) that an excerpt begins on: searched collapsed, else by its words."""
    lines = [normal_space(QUOTE.sub("", x)) for x in document.splitlines()]
    starts = [0, *itertools.accumulate(len(x) + 1 for x in lines)]
    body, wanted = " ".join(lines), normal_space(excerpt)
    line_of = lambda at: bisect_right(starts, at, hi=len(lines))
    if wanted and (found := [line_of(m.start()) for m in re.finditer(f"(?={re.escape(wanted)})", body)]):
        return found
    own, wanted = words(body), canonical(wanted)
    if not wanted:
        return []
    pieces = [("  " if wide else " ") + w for _, wide, w in own]
    begins, low = [0, *itertools.accumulate(map(len, pieces))], "".join(pieces)
    # A hit may begin inside a word; it counts where that word stands, once for each place.
    hits = dict.fromkeys((i := bisect_right(begins, m.start()) - 1, m.start() - begins[i]) for m in re.finditer(f"(?={re.escape(wanted)})", low))
    return [line_of(own[i][0]) for i, _ in hits]


def udf(fn, kind: str):
    """An Arrow-batched UDF of a function of one text; null in, null out."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else fn(x))

    return run


def links_of(docs: DataFrame) -> DataFrame:
    """path, line (from 1), link (text, destination, title) of every link outside code in (path, text)."""

    def find(text: str):
        lines = text.splitlines()
        return [{"line": i + 1, "text": lines[i][x[3] + 1 : x[3] + 1 + len(x[0])], "destination": x[1], "title": x[2]} for i, line in enumerate(strip_code(text).splitlines()) for x in links(line)]

    got = docs.select("path", F.explode(udf(find, "array<struct<line: int, text: string, destination: string, title: string>>")("text")).alias("l"))
    return got.select("path", "l.line", F.struct("l.text", "l.destination", "l.title").alias("link"))


def headings_of(docs: DataFrame) -> DataFrame:
    """path, line, level, heading, anchor of every heading."""

    def find(text: str):
        found = headings(text)
        return [{"line": n, "level": k, "heading": h, "anchor": a} for (n, k, h), a in zip(found, slugs([h for _, _, h in found]), strict=True)]

    return docs.select("path", F.explode(udf(find, "array<struct<line: int, level: int, heading: string, anchor: string>>")("text")).alias("h")).select("path", "h.*")


def markers_of(docs: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """path, id, line (from 1), offset of every statement marker."""

    def find(text: str):
        return [{"id": i, "line": n + 1, "offset": o} for i, n, o in markers(text, prefix)]

    return docs.select("path", F.explode(udf(find, "array<struct<id: string, line: int, offset: int>>")("text")).alias("m")).select("path", "m.*")


def bare_ids_of(docs: DataFrame) -> DataFrame:
    """path, line, id of every id in prose."""

    def find(text: str):
        return [{"line": i + 1, "id": x} for i, line in enumerate(strip_code(text).splitlines()) for x in bare_ids(line)]

    return docs.select("path", F.explode(udf(find, "array<struct<line: int, id: string>>")("text")).alias("t")).select("path", "t.*")
