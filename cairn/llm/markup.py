"""Clean text and structure from documents with markup (problem 5): consensus host paths.

1. Each page is read into blocks in reading order (heading, list_item, code_block, formula, paragraph). A block stands in a
   container, named by its generalised tag-class path: tags with their first class, digits removed, ids dropped, document
   wrappers left out. The container's score is the length of its text outside links, less twice the text inside links.
2. Pages vote per host (the folder of the page's path) in Spark: each has one vote on each path that it has, for it or, if
   its containers there score below 0, against it.
3. Pages are extracted again: blocks under the host's winning paths stay, blocks under paths that lost their vote go. A page
   with no block under a winning path keeps all of them.

HTML, Markdown, wiki and LaTeX are recognised together, whatever the file's name, for pages mix them. Inline formulas are
blocks of their own. Nothing inside a code block, an inline code span, a comment, a script or a page title counts.

Defined results: a null text gives no row; an empty or plain one gives its text and no markup; unclosed elements end with
the text; rows with a null id are left out; of several texts under one id the first in byte order holds; texts are read
whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.ordering import join_counted
from cairn.session import materialize

LOST_BYTES, SHOWN = 8 << 20, 6
KINDS = ("heading", "list_item", "code_block", "formula")

# Element names of HTML and of wiki extensions.
TAGS = (
    "a abbr address article aside audio b blockquote body br button caption center cite code col colgroup dd del details div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta "
    "mi mn mo mrow mtext msup msub nav nowiki ol optgroup option p pre q ref references s samp script section select small source span "
    "strike strong style sub summary sup svg syntaxhighlight table tbody td textarea tfoot th thead title tr tt u ul var video"
)
_NAME = "(?:" + "|".join(sorted(TAGS.split(), key=len, reverse=True)) + ")"
_TAG = rf"</?(?:{_NAME}|[a-z]++:[a-z]++)(?:\s[^<>]*)?/?>"
_MATH_ENV = r"(?:equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat)"

#: What begins at a place of the text, first alternative first.
_SCAN = re.compile(
    rf"""
    (?:^|(?=[<\\`$]))(?:  # all else begins a line
    (?P<comment><!--.*?(?:-->|\Z))
  | (?P<drop><(?P<dn>script|style|title)\b[^<>]*+>.*?(?:</(?P=dn)\s*>|\Z))
  | (?P<code><(?P<cn>pre|syntaxhighlight|source)\b[^<>]*+>.*?(?:</(?P=cn)\s*>|\Z)
      | \\begin\{{(?P<en>verbatim\*?|lstlisting|minted|Verbatim)\}}.*?(?:\\end\{{(?P=en)\}}|\Z)
      | ^[ ]{{0,3}}(?P<fence>`{{3,}}|~{{3,}})[^\n`]*\n.*?(?:^[ ]{{0,3}}(?P=fence)[`~]*[ \t]*$|\Z))
  | (?P<indented>(?:(?<=\n\n)|\A)(?:(?:[ ]{{4}}|\t)[^\n]*\S[^\n]*(?:\n|\Z))+)
  | (?P<formula>\$\$(?:(?!\$\$|\n[ \t]*\n).)++\$\$ | \\\[(?:(?!\\[\[\]]|\n[ \t]*\n).)++\\\] | \\\((?:(?!\\[()]|\n[ \t]*\n).)++\\\)
      | <math\b[^<>]*+>.*?(?:</math\s*>|\Z)
      | \\begin\{{(?P<fn>{_MATH_ENV}\*?)\}}.*?(?:\\end\{{(?P=fn)\}}|\Z)
      | (?<![\w$\\])\$(?=[^\s$])[^$\n]++(?<=[^\s$\\])\$(?![\w$]))
  | (?P<inline><(?P<xn>code|tt|kbd|samp|nowiki)\b[^<>]*+>.*?(?:</(?P=xn)\s*>|\Z) | (?<![`\\])(?P<tick>`{{1,2}})(?!`)[^\n]+?(?<!`)(?P=tick)(?!`))
  | (?P<heading><h[1-6]\b[^<>]*>
      | \\(?:part|chapter|(?:sub){{0,2}}section|(?:sub)?paragraph)\*?(?:\[[^\]\n]*\])?(?=\{{)
      | ^[ ]{{0,3}}(?P<hashes>\#{{1,6}})[ \t]+(?=\S)
      | ^[ \t]*(?P<eqs>={{1,6}})(?!=)(?=[ \t=]*+[^=\s])(?=[^\n]*(?P=eqs)[ \t]*$))
  | (?P<setext>^(?=[^\n]*\w)[ ]{{0,3}}(?![-*+>\#|=]|\d+[.)][ ])[^\n]*\n(?=(?:={{3,}}|-{{3,}})[ \t]*$))
  | (?P<rule>^(?:={{3,}}|-{{3,}})[ \t]*$)
  | (?P<item><li\b[^<>]*> | \\item\b(?:\[[^\]\n]*\])? | ^[ \t]*(?:[-+]|\d{{1,3}}[.)])[ \t]+(?=\S) | ^[ \t]*\*+[ \t]+(?=\S) | ^[*\#]{{1,6}}[ \t]+(?=\S))
  | (?P<env>\\(?:begin|end)\{{(?:itemize|enumerate|description)\}}(?:\[[^\[\]\n]*+\])?)
  | (?P<tag>{_TAG})
    )""",
    re.X | re.M | re.S | re.I,
)
_LINK = r"\[[^\[\]\n]*+\]\((?:[^()\n]++|\([^()\n]*+\))*+\)"
_INLINE = re.compile(
    rf"""&(?:\#\d{{1,6}}|\#x[0-9a-f]{{1,5}}|[a-z][a-z0-9]{{1,9}});
  | (?<![\w*\\])\*{{1,3}}(?=[^\s*])[^*\n]*+(?<=[^\s*])\*{{1,3}}(?![\w*])
  | ~~(?=\S)[^~\n]++~~
  | !?\[[^\[\]\n]*+\]\((?=[^)\s])(?:[^()\s]++|\([^()\s]*+\))++(?:\s+"[^"\n]*+")?\) | !?\[[^\[\]\n]++\]\[[^\[\]\n]*+\] | \[\^[\w-]++\]
  | ^[ ]{{0,3}}\[[^\[\]\n]++\]:[ \t]+\S
  | \[\[[^\[\]\n]++\]\] | \{{\{{[^{{}}]++\}}\}} | ^\{{\|.*$ | ^\|[-}}].*$
  | ^[ \t]*+\|?(?:[ \t]*+:?-{{3,}}+:?[ \t]*+\|)+[ \t]*+(?::?-{{3,}}+:?)?[ \t]*+$
  | \\(?:begin|end|documentclass|usepackage|item|label|ref|cite|footnote|textbf|textit|emph|texttt|underline|url|href|caption|title|author|maketitle|bf|it|em|tt|sc)\b
  | \\[A-Za-z]+\*?(?:\[[^\[\]\n]*+\])?\{{[^{{}}\n]*+\}}
  | \{{\\(?:bf|it|em|tt|sc|rm|sf|sl|small|large)\b[^{{}}\n]*+\}}""",
    re.X | re.M | re.I,
)
# signs whose content may hold the sign itself: where a line has a first opening one, any closing one after it will do
_PAIRED = [(re.compile(r"(?<![\w\\])_{1,3}(?=[^\s_])"), re.compile(r"(?<=[^\s_])_{1,3}(?!\w)"), "_"), (re.compile(r"''+(?=[^'\s])"), re.compile("''"), "''")]
_ANY_TAG = re.compile(_TAG, re.I)
_SIGN = re.compile(r"[&*_~\[{'\\|]")
_LATEX = re.compile(r"\\(?:documentclass|begin\{|(?:sub)*section\*?\{|item\b|textbf\{|textit\{|emph\{|cite\{|ref\{|footnote\{)")
_TABLE = re.compile(r"^[ \t]*\{\||^[ \t]*\|[-}]|^[ \t]*+\|?(?:[ \t]*+:?-{3,}+:?[ \t]*+\|)+[ \t]*+(?::?-{3,}+:?)?[ \t]*+$", re.M)
_TABLE_RULE = re.compile(r"^[ \t]*+(?:\{\|.*|\|[-}+].*|\|?(?:[ \t]*+:?-{3,}+:?[ \t]*+\|)+[ \t]*+(?::?-{3,}+:?)?[ \t]*+)$\n?", re.M)
_TABLE_ROW = re.compile(r"^[ \t]*+(?:\||!(?=[^\n]*!!))([^\n]*)$", re.M)
_LATEX_COMMENT = re.compile(r"^[ \t]*%[^\n]*$", re.M)
_WRAPPERS = {"html", "body", "head"}
_CONTAINERS = {"div", "section", "article", "main", "nav", "aside", "header", "footer", "table", "tbody", "tr", "td", "th", "form", "center", "blockquote", "ul", "ol", "dl"}
_INLINE_CONTAINERS = {"ul", "ol", "dl"}


_SCANNED = ("comment", "drop", "code", "indented", "formula", "inline", "heading", "setext", "rule", "item", "env", "tag")


def _class_of(tag: str) -> str:
    name = re.match(r"</?\s*(\w+)", tag).group(1).lower()
    cls = re.search(r"class\s*=\s*[\"']?([\w-]+)", tag, re.I)
    return name + ("." + re.sub(r"\d+", "", cls.group(1).lower()) if cls else "")


def _has_pair(s: str) -> bool:
    """Whether a line of ``s`` has emphasis whose sign may stand within it as well; one look at each line."""
    for opening, closing, sign in _PAIRED:
        if sign in s:
            for line in s.split("\n"):
                first = opening.search(line) if sign in line else None
                if first and closing.search(line, first.end() + 1):
                    return True
    return False


def _unpaired(s: str) -> str:
    """``s`` without pairs of underscores around words: each opening run closes at the next closing run of its length."""
    opening, closing, _ = _PAIRED[0]
    out = []
    for line in s.split("\n"):
        if "_" in line:
            drop: list[tuple[int, int]] = []
            pending: tuple[int, int] | None = None
            for m in re.finditer("_+", line):
                length = m.end() - m.start()
                if length > 3:
                    continue
                if pending and length == pending[1] - pending[0] and m.start() > pending[1] and closing.match(line, m.start()):
                    drop += [pending, m.span()]
                    pending = None
                elif pending is None and opening.match(line, m.start()):
                    pending = m.span()
            for a, b in reversed(drop):
                line = line[:a] + line[b:] if len(drop) < 64 else line[:a] + "\0" * (b - a) + line[b:]
            line = line.replace("\0", "")
        out.append(line)
    return "\n".join(out)


def _without_templates(s: str) -> str:
    """``s`` without what stands in double braces, nested or not; braces that do not close stay. One pass."""
    opened: list[int] = []
    spans: list[tuple[int, int]] = []
    for m in re.finditer(r"\{\{|\}\}", s):
        if m.group() == "{{":
            opened.append(m.start())
        elif opened:
            at = opened.pop()
            while spans and spans[-1][0] > at:
                spans.pop()
            spans.append((at, m.end()))
    out, last = [], 0
    for a, b in spans:
        out.append(s[last:a])
        last = b
    return "".join(out) + s[last:]


def _plain(s: str) -> str:
    """Text of a stretch without its inline markup. Each rule runs only where its sign stands, and in linear time: what it
    skips never holds the sign that it begins with."""
    if "<" in s:
        s = re.sub(r"<br\s*/?>|</?(?:p|div|tr|table|ul|ol|blockquote)\b[^<>]*>", "\n", s, flags=re.I)
        s = _ANY_TAG.sub("", s)
    if "|" in s and _TABLE.search(s):
        s = _TABLE_RULE.sub("", s)
        s = _TABLE_ROW.sub(lambda m: re.sub(r"\|\|?|!!", " ", m.group(1)), s)
    if ">" in s:
        s = re.sub(r"^[ ]{0,3}>+[ \t]?", "", s, flags=re.M)
    if "[" in s:
        s = re.sub(r"^[ ]{0,3}\[[^\[\]\n]++\]:[ \t]+\S[^\n]*$\n?", "", s, flags=re.M)
        s = re.sub("!" + _LINK, lambda m: m.group()[2 : m.group().index("]")], s)
        s = re.sub(_LINK, lambda m: m.group()[1 : m.group().index("]")] or m.group(), s)
        s = re.sub(r"!?\[([^\[\]\n]++)\]\[[^\[\]\n]*+\]", r"\1", s)
        s = re.sub(r"\[\^[\w-]++\]", "", s)
        for _ in range(2):  # a caption may hold links
            s = re.sub(r"\[\[(?:Category|File|Image):[^\[\]\n]*+\]\]", "", s, flags=re.I)
            s = re.sub(r"\[\[(?:[^\[\]|\n]*+\|)?([^\[\]|\n]*+)\]\]", r"\1", s)
    if "{{" in s:
        s = _without_templates(s)
    if "''" in s:
        s = re.sub(r"'{2,5}", "", s)
    if "\\" in s:
        s = re.sub(r"~?\\(?:ref|cite|label|footnote|pageref)\*?(?:\[[^\[\]\n]*+\])?\{[^{}\n]*+\}", "", s)
        s = re.sub(r"\\(?:documentclass|usepackage|begin|end)(?:\[[^\[\]\n]*+\])?\{[^{}\n]*+\}(?:\[[^\[\]\n]*+\])?", "", s)
        s = re.sub(r"\\(?:maketitle|tableofcontents|centering|raggedright|noindent|newpage|clearpage|bigskip|medskip|smallskip|hfill|hline|appendix)\b[ \t]*|\\\\[ \t]*$", "", s, flags=re.M)
        for _ in range(2):
            s = re.sub(r"\{\\(?:bf|it|em|tt|sc|rm|sf|sl)\s+([^{}\n]*+)\}", r"\1", s)
            s = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\[\]\n]*+\])?\{([^{}\n]*+)\}", r"\1", s)
        s = re.sub(r"\\(?:textbf|textit|textsc|emph|texttt|underline|footnote|caption)\{", "", s)  # one that never closes
    if "*" in s:
        s = re.sub(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]*+)(?<=[^\s*])\1(?![\w*])", r"\2", s)
    if "_" in s:
        s = _unpaired(s)
    if "~~" in s:
        s = re.sub(r"~~([^~\n]++)~~", r"\1", s)
    return (html.unescape(s) if "&" in s else s).replace("\u00a0", " ")


def _code_text(s: str) -> str:
    if s.lstrip()[:1] in "`~":
        lines = s.strip("\n").split("\n")
        return "\n".join(lines[1:-1] if re.match(r"\s*[`~]{3,}\s*$", lines[-1]) and len(lines) > 1 else lines[1:])
    if s.lstrip().startswith("\\begin"):
        return re.sub(r"^\s*\\begin\{\w+\*?\}(?:\[[^\]]*\])?\n?|\n?\\end\{\w+\*?\}\s*$", "", s)
    return html.unescape(re.sub(r"</?(?:pre|code|syntaxhighlight|source|span)\b[^>]*>", "", s, flags=re.I)).strip("\n")


def _formula_text(s: str) -> str:
    s = re.sub(r"^\\begin\{[^}]*\}|\\end\{[^}]*\}$|^\$\$?|\$\$?$|^\\[\[(]|\\[\])]$", "", s.strip())
    return html.unescape(re.sub(r"<[^<>]*>", "", s)).strip()


def named(path: list[tuple[str, int]]) -> str:
    """A container's path. Of deep ones the last steps are written out, and the hash of all steps tells them apart."""
    shown = ">".join(step for step, _ in path[-SHOWN:])
    return shown if len(path) <= SHOWN else f"{path[-1][1]:016x}>{shown}"


def _is_listed(text: str, at: int, end: int) -> bool:
    """Whether a ``#`` line is one of a run of list lines (wiki numbering) rather than a heading between blank lines."""
    before = text.rfind("\n", 0, max(0, at - 1)) + 1
    previous = text[before : max(0, at - 1)] if at else ""
    stop = text.find("\n", end)
    following = text[stop + 1 : stop + 1 + 8].split("\n", 1)[0] if stop >= 0 else ""
    return bool(re.match(r"[*#]+ ?\S", previous) or re.match(r"[*#]+ ?\S?", following))


def parse(text: str) -> tuple[bool, list[tuple[str, int, str, str, int, str]]]:
    """(markup found, blocks); a block is (kind, level, text, container path, characters inside links, mark of a list item)."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    found = False
    if _LATEX.search(text):
        kept, spans = [], [m.span() for m in re.finditer(r"\\begin\{(verbatim|lstlisting)\}.*?(?:\\end\{\1\}|\Z)", text, re.S)]
        last, at = 0, 0
        for m in _LATEX_COMMENT.finditer(text):
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            if at == len(spans) or m.start() < spans[at][0]:
                kept.append(text[last : m.start()])
                last, found = m.end(), True
        text = "".join(kept) + text[last:]
    blocks: list[tuple[str, int, str, str, int, str]] = []
    path: list[tuple[str, int]] = []  # open containers: class, and hash of the path down to it
    lists: list[list] = []  # open lists of HTML and LaTeX: whether they are numbered, and their last number
    state = {"kind": "paragraph", "level": 0, "buffer": [], "linked": 0, "link_from": None, "to_line_end": False, "mark": ""}

    def flush(kind: str = "paragraph", level: int = 0, mark: str = "") -> None:
        body = "".join(state["buffer"])
        body = re.sub(" ?\n ?", "\n", re.sub(r"[ \t]+", " ", body)).strip()
        body = re.sub(r"\n{3,}", "\n\n", body)
        if state["kind"] == "heading":
            bare = body.rstrip("=#")
            body = re.sub(r"^\{(.*)\}", r"\1", (bare.rstrip() if bare != body else body) or body, flags=re.S)
        if body or state["kind"] in ("heading", "list_item"):
            blocks.append((state["kind"], state["level"], body, named(path), state["linked"], state["mark"]))
        state.update(kind=kind, level=level, buffer=[], linked=0, mark=mark)

    def item(at: str) -> tuple[int, str]:
        """Level and mark of a list item that begins with ``at``."""
        sign = at.strip()
        if sign[:1] in "<\\":
            if not lists:
                return 1, "-"
            lists[-1][1] += 1
            return len(lists), f"{lists[-1][1]}." if lists[-1][0] else "-"
        indent = len(at[: len(at) - len(at.lstrip())].expandtabs(4))
        if sign[:1] in "*#":  # wiki lists, of which the numbered ones are renumbered for want of numbers
            return max(len(sign), 1 + indent // 2), "1." if sign[-1] == "#" else "-"
        return 1 + indent // 2, sign if sign[0].isdigit() else "-"

    def words(s: str) -> None:
        nonlocal found
        if not s:
            return
        if not found and _SIGN.search(s) and (_INLINE.search(s) or _has_pair(s)):
            found = True
        if state["to_line_end"] and "\n" in s:
            head, s = s.split("\n", 1)
            state["buffer"].append(_plain(head))
            state["to_line_end"] = False
            flush()
        elif state["kind"] == "list_item" and re.search(r"\n[ \t]*\n", s):
            head, s = re.split(r"\n[ \t]*\n", s, maxsplit=1)
            state["buffer"].append(_plain(head))
            flush()
        plain = _plain(s)
        if state["link_from"] is not None:
            state["linked"] += len(plain)
        state["buffer"].append(plain)

    last = 0
    for m in _SCAN.finditer(text):
        kind = m.lastgroup if m.lastgroup in _SCANNED else next(
            g for g in _SCANNED if m.group(g) is not None
        )
        s = m.group()
        words(text[last : m.start()])
        last = m.end()
        if kind == "rule":
            flush()
            continue
        found = True
        if kind in ("comment", "drop"):
            continue
        if kind in ("code", "indented"):
            flush()
            blocks.append(("code_block", 0, _code_text(s) if kind == "code" else re.sub(r"^(?: {4}|\t)", "", s, flags=re.M).strip("\n"), named(path), 0, ""))
        elif kind == "formula":
            blocks.append(("formula", 0, _formula_text(s), named(path), 0, ""))
            state["buffer"].append("$" + _formula_text(s) + "$")
        elif kind == "inline":
            state["buffer"].append(html.unescape(re.sub(r"</?\w+[^>]*>|^`+|`+$", "", s)))
        elif kind == "heading":
            hashes = m.group("hashes")
            if hashes and _is_listed(text, m.start(), m.end()):
                flush("list_item", len(hashes), "1.")
                state["to_line_end"] = True
                continue
            level = len(hashes or m.group("eqs") or "") or (int(s[2]) if s[:1] == "<" else 1 + s.count("sub"))
            flush("heading", level)
            state["to_line_end"] = s[:1] != "<"
        elif kind == "setext":
            flush("heading", 1 if text[m.end() : m.end() + 1] == "=" else 2)
            words(s.rstrip("\n"))
            flush()
        elif kind == "item":
            flush("list_item", *item(s.split("[")[0] if s[:1] == "\\" else s))
            state["to_line_end"] = False
        elif kind == "env":
            if s[1] == "b":
                lists.append(["enumerate" in s, 0])
            elif lists:
                lists.pop()
            state["buffer"].append("\n")
        else:
            name = re.match(r"</?\s*(\w+)", s).group(1).lower()
            if name == "a":
                state["link_from"] = None if s[1] == "/" else m.end()
            elif name == "li" or re.fullmatch("h[1-6]", name):
                flush()
            elif name in _CONTAINERS:
                flush()
                if name in ("ul", "ol"):
                    if s[1] != "/":
                        lists.append([name == "ol", 0])
                    elif lists:
                        lists.pop()
                if s[1] == "/":
                    at = next((k for k in range(len(path) - 1, -1, -1) if path[k][0].split(".")[0] == name), None)
                    if at is not None:
                        del path[at:]
                elif not s.endswith("/>") and name not in _INLINE_CONTAINERS:
                    step = _class_of(s)
                    path.append((step, xxhash.xxh64_intdigest(step.encode(), path[-1][1] if path else 0)))
            elif name in ("p", "br"):
                state["buffer"].append("\n")
                if name == "p" and state["kind"] != "list_item":
                    flush()
            elif name in _WRAPPERS:
                flush()
            elif name == "ref" and s[1] != "/":
                state["buffer"].append(" ")
    words(text[last:])
    flush()
    return found, blocks


BLOCK = "struct<kind:string,level:int,text:string,path:string,linked:int,mark:string>"


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = [parse(t) for t in pdf["text"]]
        yield pd.DataFrame({"id": pdf["id"], "host": pdf["host"], "markup": [m for m, _ in done], "blocks": [[dict(zip(("kind", "level", "text", "path", "linked", "mark"), b)) for b in bs] for _, bs in done]})


def host_of(path: F.Column) -> F.Column:
    """The folder of a path or the host of an address; empty if unknown."""
    host = F.regexp_extract(path, r"^[a-z]+://([^/]+)", 1)
    return F.coalesce(F.when(host != "", host).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1)), F.lit(""))


def pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "content", path_col: str = "path") -> DataFrame:
    """(id, host, markup, blocks): first pass, a written table."""
    rows = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    one = rows.groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(text_col).alias("t"), F.col(path_col).alias("p"))).alias("m"))
    kind = dict(one.dtypes)["id"]
    return materialize(one.select("id", F.col("m.t").alias("text"), host_of(F.col("m.p")).alias("host")).mapInPandas(_parsed, f"id {kind}, host string, markup boolean, blocks array<{BLOCK}>"), "pages")


def votes(first: DataFrame) -> DataFrame:
    """(host, path, votes, pages, wins): the vote on container paths of each host. Every page with such a container has one
    vote, whatever its length: for the path if its containers there score 0 or more, against it otherwise."""
    b = first.select("id", "host", F.explode("blocks").alias("b")).select("id", "host", "b.*")
    score = F.length("text") - 3 * F.col("linked")  # plain characters less twice the linked ones
    per_page = b.groupBy("host", "path", "id").agg(F.sum(score).alias("score"))
    vote = F.sum(F.when(F.col("score") >= 0, 1).otherwise(-1))
    return per_page.groupBy("host", "path").agg(vote.alias("votes"), F.count("*").alias("pages")).withColumn("wins", F.col("votes") >= 0)


def extract(documents: DataFrame, id_col: str = "doc_id", text_col: str = "content", path_col: str = "path") -> DataFrame:
    """(id, markup, blocks): the blocks of each document under its host's winning paths.

    Only hosts where a path has lost are looked up. While these lists are few they travel to the pages; otherwise the pages of
    a host meet them by its name, those of hosts with many pages by broadcast.
    """
    first = pages(documents, id_col, text_col, path_col)
    lost = materialize(votes(first).where(~F.col("wins")).groupBy("host").agg(F.collect_set("path").alias("lost")), "lost")
    size = lost.agg(F.coalesce(F.sum(F.octet_length("host") + F.aggregate("lost", F.lit(0), lambda a, p: a + F.octet_length(p) + 16)), F.lit(0))).first()[0]
    if size <= LOST_BYTES:
        voted = first.join(F.broadcast(lost), "host", "left")
    else:
        hosts = first.groupBy("host").agg(F.count("*").alias("n")).join(lost, "host", "left")
        voted = join_counted(first, materialize(hosts, "hosts"), "host", "n", first.count())
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains(F.col("lost"), b["path"]), F.lit(False)))
    return voted.select("id", "markup", F.when(F.size(kept) > 0, kept).otherwise(F.col("blocks")).alias("blocks"))


def clean_text(extracted: DataFrame) -> DataFrame:
    """(id, markup, text): blocks as text; headings, items, code and formulas stay recognisable."""
    def shown(b):  # noqa: ANN001, ANN202
        return (
            F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(b["level"], F.lit(1))), F.lit(" "), b["text"]))
            .when(b["kind"] == "list_item", F.concat(F.repeat(F.lit("  "), F.greatest(b["level"] - 1, F.lit(0))), b["mark"], F.lit(" "), b["text"]))
            .when(b["kind"] == "code_block", F.concat(F.lit("```\n"), b["text"], F.lit("\n```")))
            .otherwise(b["text"])
        )

    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["kind"] != "formula"), shown), "\n\n")
    return extracted.select("id", "markup", text.alias("text"))


def structure(extracted: DataFrame) -> DataFrame:
    """(id, kind, pos): ``markup`` at 0 where any was found; each heading, list item, code block and formula from 1 on."""
    of_kind = lambda k: F.transform(F.filter("blocks", lambda b: b["kind"] == k), lambda b, i: F.struct(F.lit(k).alias("kind"), (i + 1).cast("int").alias("pos")))
    head = F.array(F.struct(F.lit("markup").alias("kind"), F.lit(0).alias("pos")))
    every = F.concat(head, *(of_kind(k) for k in KINDS))
    return extracted.where("markup").select("id", F.explode(every).alias("e")).select("id", "e.kind", "e.pos")


def residue(extracted: DataFrame, signs: dict[str, str]) -> DataFrame:
    """(sign, records, left): of each kind of markup (name and pattern), the number of records and of those whose clean text
    still has it. Code blocks and formulas are no residue."""
    words = F.array_join(F.transform(F.filter("blocks", lambda b: ~b["kind"].isin("code_block", "formula")), lambda b: b["text"]), "\n")
    counts = extracted.select(words.alias("t")).agg(F.count("*").alias("records"), *(F.count_if(F.col("t").rlike(p)).alias(n) for n, p in signs.items()))
    return counts.select("records", F.inline(F.array(*(F.struct(F.lit(n).alias("sign"), F.col(n).alias("left")) for n in signs)))).select("sign", "records", "left")
