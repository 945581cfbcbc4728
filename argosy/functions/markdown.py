"""Structure of Markdown documents: statements, sections, child lists, bibliographies, mentions, and edits of single lines."""

from __future__ import annotations

import os.path
import posixpath
import re
import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosy.functions import text as T

# Block kinds that no premise relation can hold, and the kinds that a hand-written mention names.
NO_PREMISE = frozenset("section sections chapter figure table equation appendix part definition remark example notation algorithm".split())
RESULTS = ("theorem", "proposition", "corollary", "lemma", "conjecture", "claim", "definition", "remark", "example")


def section(text: str, anchor: str) -> str | None:
    """The code-stripped body under the heading of that anchor, up to the next heading as deep or shallower."""
    found = T.headings(text)
    lines = T.strip_code(text).split("\n")
    for i, ((line, level, _), own) in enumerate(zip(found, T.slugs([h for _, _, h in found]), strict=True)):
        if own == anchor:
            end = next((n for n, k, _ in found[i + 1 :] if k <= level), len(lines) + 1)
            return "\n".join(lines[line : end - 1])
    return None


def statement(text: str, id: str) -> str:
    """What an id's first marker marks, "" without one."""
    return statements(text).get(id, "")


def statements(text: str) -> dict[str, str]:
    """For each id what its first marker marks: its section if it stands under a heading, its quote if it is quoted, else its paragraph; markers are left out."""
    lines, heads, out = text.splitlines(), T.headings(text), {}
    bare = lambda rows: T.without_markers("\n".join(T.QUOTE.sub("", x) for x in rows)).strip()
    held: dict[tuple[bool, int], str] = {}  # what a quoted or plain block's lines hold, each block read once
    for id, at, _ in T.markers(text):
        quoted = bool(T.QUOTE.match(lines[at]))
        if id in out or (quoted, at) in held:
            out.setdefault(id, held.get((quoted, at)))
            continue
        same = (lambda x: bool(T.QUOTE.match(x))) if quoted else (lambda x: bool(x.strip()) and not T.HEADING.match(x))
        first = last = at
        while first > 0 and same(lines[first - 1]):
            first -= 1
        while last + 1 < len(lines) and same(lines[last + 1]):
            last += 1
        own = bare(lines[first : last + 1])
        if not own and first > 0 and (above := T.HEADING.match(lines[first - 1])):
            end = next((n for n, k, _ in heads if n > first and k <= len(above[1])), len(lines) + 1)
            own = bare(lines[last + 1 : end - 1])
        out[id] = own
        held |= {(quoted, i): own for i in range(first, last + 1)}
    return out


def statements_of(docs: DataFrame) -> DataFrame:
    """id, statement of every marked id in (path, text); of documents that mark an id the first by path counts."""
    found = docs.select("path", F.explode(T.udf(statements, "map<string, string>")("text")).alias("id", "statement"))
    return found.groupBy("id").agg(F.min_by("statement", "path").alias("statement"))


def child_list(source: str, text: str) -> list[str]:
    """Documents that list lines link to, resolved, each once, in order."""
    out = []
    for line in T.strip_code(text).splitlines():
        if re.match(r"\s*(?:[-*+]|\d+[.)])\s+", line):
            out += [p for _, d, _, _, _ in T.links(line) for p, _ in [T.resolved(source, d)] if p.endswith(".md")]
    return list(dict.fromkeys(out))


def up_link(source: str, text: str) -> str | None:
    """The document that the first line with content links up to."""
    first = next((x for x in text.splitlines() if x.strip()), "")
    m = re.match(r"\s*(?:↑|\[↑|Up:)", first)
    found = T.links(first) if m or first.startswith("[") else []
    return T.resolved(source, found[0][1])[0] if found else None


def title(sentence: str, position: int, taken: set[str], most: int = 120) -> str:
    """A claim's title: its sentence on one line, cut at a word within the limit, with its place if it is empty or taken."""
    words = T.normal_space(sentence)
    if len(words) > most:
        cut = words[:most]
        words = (cut.rsplit(" ", 1)[0] if " " in cut else cut[:-1]) + "…"
    return words if words and words not in taken else f"{words} (¶{position})".strip()


def opens_claim(sentence: str, line: int, shut: list[tuple[int, int]], least: int = 4) -> bool:
    """Enough canonical words, and no maths fence around its line."""
    return len(T.canonical(sentence).split()) >= least and not any(a <= line < b for a, b in shut)


def names_no_premise(word: str) -> bool:
    """Whether the word before an anchor names a kind that can be no premise; plurals and abbreviations count."""
    kind = word.lower().rstrip(".")
    return bool(kind) and (kind in NO_PREMISE or (kind.endswith("s") and kind[:-1] in NO_PREMISE))


_NUMBER = r"\d+(?:\.\d+)*"
_MENTION = re.compile(rf"\b({'|'.join(sorted(RESULTS, key=len, reverse=True))}|corollarie)s?\s+(?={_NUMBER})", re.IGNORECASE)
_ITEM = re.compile(_NUMBER)
#: What stands between two numbers: no part of it can be read in two ways, so it takes linear time.
_BETWEEN = re.compile(rf"\s*((?:(?:,|and|or|to|-|–)\s*)+)(?={_NUMBER})")
_RANGE = re.compile("to|-|–")


def mentions(text: str) -> list[tuple[str, str, str | None]]:
    """(kind, number, through) of mentions by hand, as "Lemmas 2.1, 2.3 and 4" or "Theorems 1-3".

    A range of two rising numbers under one head is one row, through its last number; what else a sign of a range stands between are numbers of their own.
    """
    out, at = [], 0
    while m := _MENTION.search(text, at):
        kind, at, joined = m[1].lower().replace("corollarie", "corollary"), m.end(), ""
        while number := _ITEM.match(text, at):
            at = number.end()
            low = out[-1] if joined else None
            a, b = (low[1].rpartition(".") if low else None), number[0].rpartition(".")
            rising = low is not None and low[2] is None and len(_RANGE.findall(joined)) == 1 and a[0] == b[0] and (len(a[2]), a[2]) < (len(b[2]), b[2])
            if rising:
                out[-1] = (kind, low[1], number[0])
            else:
                out.append((kind, number[0], None))
            between = _BETWEEN.match(text, at)
            if not between:
                break
            joined, at = between[1], between.end()
    return out


def mentions_of(docs: DataFrame) -> DataFrame:
    """path, rank (from 1), kind, number, through (null, or a range's last number) of every mention by hand in (path, text)."""
    find = T.udf(lambda x: [{"kind": k, "number": n, "through": t} for k, n, t in mentions(x)], "array<struct<kind: string, number: string, through: string>>")
    return docs.select("path", F.posexplode(find("text")).alias("at", "m")).select("path", (F.col("at") + 1).alias("rank"), "m.kind", "m.number", "m.through")


def bibliography(text: str) -> list[str]:
    """Keys of a reference list's entries, in order."""
    return [m[1] for line in T.strip_code(text).splitlines() if (m := re.match(r"\s*(?:[-*+]\s+)?\[(?:\^)?([^\]\s]+)\]:?\s+\S", T.QUOTE.sub("", line)))]


def citation_keys(text: str) -> list[str]:
    """Keys of citation spans, as [@a; @b]."""
    return [k for m in re.finditer(r"\[([^\[\]]*@[^\[\]]*)\]", T.strip_code(text)) for k in re.findall(r"@([\w:.#$%&+?<>~/-]*\w)", m[1])]


def runs_within(words: list[str], text: list[str]) -> bool:
    """Whether a run of words stands contiguously in a text."""
    return not words or any(text[i : i + len(words)] == words for i in range(len(text) - len(words) + 1))


def record_number(x: float | None) -> str:
    """A strength as records spell it: the fewest of 4 to 15 decimals that read back within 1e-9, zeros trimmed."""
    if x is None:
        return "*pending*"
    s = next((s for d in range(4, 16) if abs(float(s := f"{x:.{d}f}") - x) < 1e-9), repr(x))
    return s.rstrip("0").rstrip(".") if "." in s else s


def label_lines(label: str, width: int = 24) -> list[str]:
    """A node's label wrapped for a drawing."""
    return textwrap.wrap(label, width) or [""]


def link_to(document: str, target: str, anchor: str = "") -> str:
    """A destination relative to the document that holds the link."""
    path = posixpath.normpath(os.path.relpath(target, posixpath.dirname(document) or ".")).replace(os.sep, "/")
    return path + (f"#{anchor}" if anchor else "")


def add_citation(text: str, line: int, snippet: str, destination: str, id: str) -> str:
    """The text with the one span on the line (from 1) as a citation; unchanged if the line holds that link."""
    lines = text.split("\n")
    link = f'[{snippet}]({destination} "{id}")'
    held = lines[line - 1]
    if link in held:
        return text
    if held.count(snippet) != 1:
        raise ValueError(f"line {line} holds {held.count(snippet)} such spans")
    lines[line - 1] = held.replace(snippet, link)
    return "\n".join(lines)


def cite_bare_ids(text: str, titles: dict[str, str], destinations: dict[str, str]) -> str:
    """The text with every bare id that has a destination as a citation by title."""
    plain, out = T.strip_code(text).split("\n"), []
    for raw, line in zip(text.split("\n"), plain, strict=False):
        for id in dict.fromkeys(T.bare_ids(line)):
            if id in destinations:
                raw = re.sub(rf"(?<![\w\[\"-]){id}(?![\w\]\"-])", f'[{titles[id]}]({destinations[id]} "{id}")', raw)
        out.append(raw)
    return "\n".join(out)


def add_marker(text: str, line: int, id: str, prefix: str = T.PREFIX) -> str:
    """The text with a statement marker after the line's last character; unchanged if the line has it."""
    lines, own = text.split("\n"), f"<!-- {prefix}: {id} -->"
    body, rest = re.fullmatch(r"(?s)(.*?)([ \t]*)", lines[line - 1]).groups()
    if own not in body:
        lines[line - 1] = f"{body} {own}{rest}"
    return "\n".join(lines)


def drop_marker(text: str, id: str, prefix: str = T.PREFIX) -> str:
    """The text without the id's markers."""
    return re.sub(rf"(?:(?<![ \t])[ \t]+)?<!--\s*{re.escape(prefix)}:\s*{id}\s*-->", "", text)


def move_marker(text: str, line: int, id: str, prefix: str = T.PREFIX) -> str:
    """The text with the id's marker on another line."""
    return add_marker(drop_marker(text, id, prefix), line, id, prefix)


def repoint(text: str, moved: dict[str, str]) -> str:
    """The text with the destinations of links changed by a map."""
    return T.LINK.sub(lambda m: m[0].replace(m[2], moved[m[2]], 1) if m[2] in moved else m[0], text)
