"""Markdown: blocks with their heading paths, plain text, outline, links.

A reader of the common subset: ATX and setext headings, fences, indented code,
lists, quotes, tables, HTML, definitions, thematic breaks and paragraphs. It
goes over the lines once; block text is the source's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`\n]*)$")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*))?$")
HTML = re.compile(r"^ {0,3}<(?:[A-Za-z/!?])")
DEFINITION = re.compile(r"^ {0,3}\[[^\]]+\]:[ \t]*\S+.*$")
TABLE_RULE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
WIKI = r"\[\[(?P<wiki>[^\]\n]+)\]\]"
LINK = r"(?<![!\\])\[(?P<text>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\([ \t]*(?:<(?P<angle>[^>\n]*)>|(?P<url>[^\s()]*(?:\([^\s()]*\)[^\s()]*)*))(?:[ \t\n]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*\)"
ANY_LINK = re.compile(f"{WIKI}|{LINK}")
IMAGE = re.compile(r"!\[([^\]]*)\]\([^)]*\)")
CODE_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
MARKS = re.compile(r"(\*\*\*|\*\*|~~|\*)(?=\S)(.+?)(?<=\S)\1|(?<![A-Za-z0-9])(___|__|_)(?=\S)(.+?)(?<=\S)\3(?![A-Za-z0-9])", re.S)
EXTERNAL = re.compile(r"^[a-z][a-z0-9+.-]*:", re.I)


@dataclass
class Node:
    kind: str  # heading, code, list, html, rule, definition, quote, table, paragraph
    text: str
    depth: int = 0
    lang: str | None = None
    items: list[str] = field(default_factory=list)


def _indent(line: str) -> int:
    return len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip(" "))


def _starts_block(line: str) -> bool:
    """Whether a line ends a paragraph by beginning something else."""
    item = ITEM.match(line)
    return bool(FENCE.match(line) or ATX.match(line) or RULE.match(line) or line.lstrip().startswith(">") and _indent(line) < 4 or HTML.match(line) or item and item[4] and (not item[2][0].isdigit() or item[2][:-1] == "1"))


def nodes(source: str) -> Iterator[Node]:
    """The top-level blocks of a document in order."""
    lines = source.split("\n")
    i, n = 0, len(lines)
    while i < n:
        line = lines[i].rstrip("\r")
        if not line.strip():
            i += 1
            continue
        begin = i
        if fence := FENCE.match(line):
            i += 1
            close = re.compile(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*\r?$")
            while i < n and not close.match(lines[i]):
                i += 1
            i = min(n, i + 1)
            yield Node("code", "\n".join(lines[begin:i]).strip(), lang=(fence[2].split() or [None])[0])
        elif _indent(line) >= 4:
            last = i
            while i < n and (not lines[i].strip() or _indent(lines[i]) >= 4):
                last = i if lines[i].strip() else last
                i += 1
            i = last + 1
            yield Node("code", "\n".join(lines[begin:i]).strip())
        elif head := ATX.match(line):
            i += 1
            yield Node("heading", (head[2] or "").strip(), depth=len(head[1]))
        elif RULE.match(line):
            i += 1
            yield Node("rule", line)
        elif ITEM.match(line):
            i, items = _list(lines, i)
            yield Node("list", "\n".join(lines[begin:i]).strip(), items=items)
        elif line.lstrip().startswith(">"):
            while i < n and lines[i].strip() and (lines[i].lstrip().startswith(">") or not _starts_block(lines[i])):
                i += 1
            yield Node("quote", "\n".join(lines[begin:i]).strip())
        elif HTML.match(line):
            while i < n and lines[i].strip():
                i += 1
            yield Node("html", "\n".join(lines[begin:i]).strip())
        elif DEFINITION.match(line):
            i += 1
            yield Node("definition", line)
        elif "|" in line and i + 1 < n and TABLE_RULE.match(lines[i + 1].rstrip("\r")) and "-" in lines[i + 1]:
            while i < n and lines[i].strip() and not _starts_block(lines[i]):
                i += 1
            yield Node("table", "\n".join(lines[begin:i]).strip())
        else:
            i += 1
            while i < n and lines[i].strip():
                if under := SETEXT.match(lines[i].rstrip("\r")):
                    i += 1
                    yield Node("heading", "\n".join(lines[begin : i - 1]).strip(), depth=1 if under[1][0] == "=" else 2)
                    break
                if _starts_block(lines[i]):
                    yield Node("paragraph", "\n".join(lines[begin:i]).strip())
                    break
                i += 1
            else:
                yield Node("paragraph", "\n".join(lines[begin:i]).strip())


def _list(lines: list[str], i: int) -> tuple[int, list[str]]:
    """Where a list that starts at line i ends, and its items' source."""
    first = ITEM.match(lines[i].rstrip("\r"))
    style = first[2][-1]
    starts, width, n = [], 0, len(lines)
    while i < n:
        line = lines[i].rstrip("\r")
        item = ITEM.match(line)
        if not line.strip():
            ahead = i
            while ahead < n and not lines[ahead].strip():
                ahead += 1
            after = lines[ahead].rstrip("\r") if ahead < n else ""
            more = ITEM.match(after)
            if ahead == n or not (_indent(after) >= width or more and more[2][-1] == style and not RULE.match(after)):
                break
            i = ahead
            continue
        if _indent(line) >= width and starts:
            i += 1
        elif item and item[2][-1] == style and not RULE.match(line):
            starts.append(i)
            width = len(item[1]) + len(item[2]) + min(len(item[3] or " "), 4)
            i += 1
        elif starts and not _starts_block(line) and lines[i - 1].strip():
            i += 1  # a paragraph's lazy next line
        else:
            break
    return i, ["\n".join(lines[a:b]).strip() for a, b in zip(starts, [*starts[1:], i], strict=True)]


def inline_text(text: str) -> str:
    """Text without its inline markup."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[2].strip() if m[2].strip() else m[2])
        return f"\0{len(kept) - 1}\0"

    text = CODE_SPAN.sub(keep, text)
    text = IMAGE.sub(r"\1", text)
    text = re.sub(LINK, lambda m: m["text"], text)
    text = re.sub(r"<([a-z][a-z0-9+.-]*:[^\s<>]*)>", r"\1", text, flags=re.I)
    for _ in range(3):
        text = MARKS.sub(lambda m: m[2] or m[4], text)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], text)


def _body_text(node_kind: str, text: str) -> str:
    if node_kind == "quote":
        text = re.sub(r"(?m)^ {0,3}> ?", "", text)
        return "".join(_body_text(x.kind, x.text) for x in nodes(text))
    if node_kind == "item":
        m = ITEM.match(text.split("\n", 1)[0])
        inner = re.sub(r"(?m)^ {1,4}", "", text[len(m[1]) + len(m[2]) :].lstrip(" \t")) if m else text
        inner = re.sub(r"^\[[ xX]\][ \t]+", "", inner)
        return "".join(_body_text(x.kind, x.text) for x in nodes(inner))
    if node_kind == "list":
        return "".join(_body_text("item", x) for n in nodes(text) for x in n.items or [n.text])
    if node_kind == "table":
        rows = [r for k, r in enumerate(text.split("\n")) if k != 1]
        return "".join(inline_text(c.strip()) for r in rows for c in re.split(r"(?<!\\)\|", r.strip().strip("|")))
    if node_kind == "code":
        return re.sub(r"^(`{3,}|~{3,})[^\n]*\n?|\n?(`{3,}|~{3,})[ \t]*$", "", text)
    return inline_text(re.sub(r"(?m)^[ \t]+", "", text))


def outline(headings: list[tuple[int, str]]) -> str | None:
    """A numbered, indented table of contents over the depths that occur."""
    if not headings:
        return None
    level = {d: i for i, d in enumerate(sorted({d for d, _ in headings}))}
    count: list[int] = []
    out = []
    for depth, text in headings:
        at = level[depth]
        count = count[: at + 1] + [0] * (at + 1 - len(count))
        count = [c or 1 for c in count[:at]] + [count[at] + 1]
        out.append(f"{'  ' * at}{'.'.join(map(str, count))}. {text}")
    return "\n".join(out)


def parse(source: str) -> dict:
    """title, plain, outline, headings and blocks of a document."""
    path: list[str] = []
    title, plain, headings, blocks = None, [], [], []

    def block(kind: str, text: str, lang: str | None = None) -> None:
        if text:
            blocks.append({"ord": len(blocks), "heading_path": [p for p in path if p], "kind": kind, "text": text, "lang": lang})

    for node in nodes(source):
        if node.kind == "heading":
            text = inline_text(node.text).strip()
            if text:
                headings.append((node.depth, text))
                plain.append(text)
                title = text if title is None and node.depth == 1 else title
                path = path[: node.depth - 1]
                path += [""] * (node.depth - 1 - len(path)) + [text]
        elif node.kind == "code":
            block("code", node.text, node.lang)
        elif node.kind == "list":
            for item in node.items:
                block("prose", item)
                plain.append(_body_text("item", item).strip())
        elif node.kind in ("paragraph", "quote", "table"):
            block("prose", node.text)
            plain.append(_body_text(node.kind, node.text).strip())
    return {
        "title": title,
        "plain": "\n\n".join(p for p in plain if p),
        "outline": outline(headings),
        "headings": [{"depth": d, "text": t} for d, t in headings],
        "blocks": blocks,
    }


def _link(raw: str, anchor: str | None, kind: str) -> dict | None:
    before, bar, display = raw.partition("|")
    target, mark, heading = before.partition("#")
    shown = display.strip() if bar else anchor
    if not target.strip():
        return None
    return {"target": target.strip(), "anchor": shown or None, "heading": heading.strip() or None if mark else None, "kind": kind}


def links(source: str) -> list[dict]:
    """Wiki and markdown links outside code, each target and anchor once."""
    found: dict[tuple[str, str | None], dict] = {}
    for node in nodes(source):
        if node.kind in ("code", "html", "rule", "definition"):
            continue
        text = node.text
        if node.kind in ("list", "quote"):  # fences may stand within
            text = re.sub(r"(?ms)^[ \t>]*(?:[-+*][ \t]+)?(`{3,}|~{3,}).*?^[ \t>]*\1[ \t]*$", "", text)
        text = CODE_SPAN.sub(lambda m: " " * len(m[0]), text)
        for m in ANY_LINK.finditer(text):
            if m["wiki"] is not None:
                link = _link(m["wiki"], None, "wikilink")
            else:
                url = m["angle"] if m["angle"] is not None else m["url"] or ""
                if EXTERNAL.match(url):
                    continue
                target = re.sub(r"(?i)\.md$", "", re.sub(r"^\.?/*", "", unquote(url, errors="strict") if _decodes(url) else url))
                link = _link(target, inline_text(m["text"]).strip() or None, "mdlink")
            if link:
                found.setdefault((link["target"], link["anchor"]), link)
    return list(found.values())


def _decodes(url: str) -> bool:
    try:
        unquote(url, errors="strict")
    except UnicodeDecodeError:
        return False
    return not re.search(r"%(?![0-9A-Fa-f]{2})", url)


BLOCKS = "array<struct<ord:int,heading_path:array<string>,kind:string,text:string,lang:string>>"
PARSED = f"struct<title:string,plain:string,outline:string,headings:array<struct<depth:int,text:string>>,blocks:{BLOCKS}>"
LINKS = "array<struct<target:string,anchor:string,heading:string,kind:string>>"


def parsed(body: Column) -> Column:
    @F.pandas_udf(PARSED)
    def run(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(b or "") for b in bodies], columns=["title", "plain", "outline", "headings", "blocks"])

    return run(body)


def parsed_links(body: Column) -> Column:
    @F.pandas_udf(LINKS)
    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series([links(b or "") for b in bodies])

    return run(body)
