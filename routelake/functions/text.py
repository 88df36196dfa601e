"""Text columns: sanitising, hashing, messages, languages, model tiers.  Column in, Column out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from routelake.functions import lexicon as lx

#: White space as Python's str methods and patterns know it, and as JavaScript does.
PY_SPACE = r"[\s\x1c-\x1f]"
JS_SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def bound(value: Column, body) -> Column:
    """``body`` of the value, which is computed once; else each of its many uses would compute it again."""
    return F.transform(F.array(value), body)[0]


def collapse(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){PY_SPACE}+", " "))


def prompt_hash(text: Column) -> Column:
    """SHA-256 of the text, lower-cased and with collapsed white space."""
    return F.sha2(F.encode(collapse(F.lower(text)), "utf-8"), 256)


def sanitize_prompt(text: Column) -> Column:
    """Role lines removed (white space after the colon may span lines), NUL to space, collapsed."""
    kept = F.regexp_replace(text, rf"(?imdU)^{PY_SPACE}*({lx.ROLE_LINE}){PY_SPACE}*:{PY_SPACE}*.*$", "")
    return collapse(F.translate(kept, "\0", " "))


def _filled(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", text)


def message_role(role: Column, origin: Column) -> Column:
    """``role``, or ``from`` where that is empty, in lower case."""
    return F.lower(F.coalesce(_filled(role), _filled(origin), F.lit("")))


def message_text(message: Column) -> Column:
    """Text of a message held as VARIANT: a string, or an object whose ``content``, else ``value``,
    else ``text`` (by presence of the key; a null that is present gives no text) is a string or a
    list of strings and objects with ``text``."""

    def kind(v):
        return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))

    def string(v, path="$"):
        return F.try_variant_get(v, path, "string")

    parts = {key: F.try_variant_get(message, f"$.{key}", "variant") for key in ("content", "value", "text")}
    value = F.coalesce(*parts.values())
    items = F.try_variant_get(value, "$", "array<variant>")
    part = lambda v: F.when(kind(v) == "STRING", string(v)).when(kind(v).startswith("OBJECT") & (kind(F.try_variant_get(v, "$.text", "variant")) == "STRING"), string(v, "$.text"))
    listed = F.array_join(F.filter(F.transform(items, part), lambda x: x.isNotNull()), "\n")
    inner = F.when(kind(value) == "STRING", string(value)).when(kind(value).startswith("ARRAY"), listed)
    return F.coalesce(F.when(kind(message) == "STRING", string(message)).when(kind(message).startswith("OBJECT"), inner), F.lit(""))


def user_turns(turns: Column) -> Column:
    """Sanitised non-empty texts of the user's turns, two line feeds between; ``turns`` is an ordered array of (role, text)."""
    own = F.filter(turns, lambda t: F.lower(F.coalesce(t["role"], F.lit(""))).isin("", "user", "human"))
    return F.array_join(F.filter(F.transform(own, lambda t: sanitize_prompt(t["text"])), lambda x: x != ""), "\n\n")


def listed_user_turns(prompt: Column) -> Column:
    """As ``user_turns`` for a VARIANT: a text, sanitised, or a list of texts and objects in any mixture.

    A text in the list counts whatever its place, an object by its ``role`` (else ``from``); all
    else, and a prompt that is neither, gives no text.
    """
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    role = lambda m: message_role(F.try_variant_get(m, "$.role", "string"), F.try_variant_get(m, "$.from", "string"))
    items = F.when(kind(prompt).startswith("ARRAY"), F.try_variant_get(prompt, "$", "array<variant>"))
    own = F.filter(items, lambda m: (kind(m) == "STRING") | (kind(m).startswith("OBJECT") & role(m).isin("", "user", "human")))
    texts = F.filter(F.transform(own, lambda m: sanitize_prompt(message_text(m))), lambda x: x != "")
    alone = F.when(kind(prompt) == "STRING", sanitize_prompt(F.try_variant_get(prompt, "$", "string")))
    return F.coalesce(alone, F.array_join(texts, "\n\n"), F.lit(""))


def normalized_language(language: Column) -> Column:
    return F.translate(F.lower(collapse(F.coalesce(language, F.lit("")))), "_", "-")


def is_english(language: Column) -> Column:
    return normalized_language(language).isin(lx.ENGLISH)


#: A JSON text's strings, brackets, commas, and what lies between.
JSON_TOKEN = r'"(?:[^"\\]++|\\.)*+"|[\[\]{},]|[^"\[\]{},]+'


def _list_items(value: Column) -> Column:
    """The JSON texts of a VARIANT's items, of lists within lists at any depth; a value that is no list is its only item.

    Brackets and commas outside of objects end an item, and objects are told by counting their braces.
    """
    tokens = F.regexp_extract_all(F.to_json(value), F.lit(JSON_TOKEN), F.lit(0))
    begin = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))

    def step(state: Column, token: Column) -> Column:
        depth = state["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        ends = (state["depth"] == 0) & token.isin("[", "]", ",")
        return F.struct(depth.alias("depth"), F.concat(state["text"], F.when(ends, F.lit("\n")).otherwise(token)).alias("text"))

    flat = F.aggregate(tokens, begin, step, lambda state: state["text"])
    return F.filter(F.split(flat, "\n"), lambda item: item != "")


def moderation_flagged(value: Column) -> Column:
    """Whether a moderation VARIANT is true, has ``flagged`` or a category true, or is a list with such an item, at any depth."""
    is_true = lambda v, path: F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False)) & (F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("")) == "BOOLEAN")

    def flagged(item: Column) -> Column:
        own = F.try_parse_json(item)
        named = F.exists(F.coalesce(F.map_values(F.try_variant_get(own, "$.categories", "map<string,variant>")), F.array()), lambda v: is_true(v, "$"))
        whole = F.coalesce(F.schema_of_variant(own), F.lit("")).startswith("OBJECT")
        return (item == "true") | (whole & (is_true(own, "$.flagged") | named))

    return F.coalesce(F.exists(_list_items(value), flagged), F.lit(False))


def model_rule(model: Column) -> Column:
    """Number of the first tier rule that the name matches, from 1; null if none does."""
    name = F.lower(collapse(model))
    return F.coalesce(*[F.when(name.rlike(pattern), F.lit(i)) for i, (_, pattern, _) in enumerate(lx.MODEL_TIERS, 1)])


def model_tier(model: Column) -> Column:
    """strong where any strong rule matches, else weak where any weak one does, else skip."""
    name = F.lower(collapse(model))
    any_of = lambda tier: name.rlike("|".join(f"(?:{pattern})" for own, pattern, _ in lx.MODEL_TIERS if own == tier))
    return F.when(any_of("strong"), "strong").when(any_of("weak"), "weak").otherwise("skip")


def model_reason(model: Column) -> Column:
    """Why a model has its tier."""
    told = [F.lit(reason) for _, _, reason in lx.MODEL_TIERS]
    rule = model_rule(model)
    return F.when(rule.isNull(), lx.SKIP_REASON).otherwise(F.element_at(F.array(*told), F.coalesce(rule, F.lit(1))))


def strip_think(text: Column, client: bool = False) -> Column:
    """Without reasoning tags: closed ones with their content, unclosed ones to the end, stray ends.

    The server form always trims the start; the client form first drops a trailing part of a
    tag and trims only if it changed anything.
    """
    tags = ["<think>", "</think>"]
    partial = "|".join(sorted({tag[:n] for tag in tags for n in range(1, len(tag))}, key=len, reverse=True))
    start = F.regexp_replace(text, f"(?i)(?:{partial})$", "") if client else text
    steps = [r"(?is)<think\b[^>]*>.*?</think>", r"(?is)<think\b[^>]*>.*$", r"(?i)</think>"]
    out = reduce(lambda t, pattern: F.regexp_replace(t, pattern, ""), steps, start)
    trimmed = F.regexp_replace(out, f"^{JS_SPACE}+", "")
    return F.when(out != text, trimmed).otherwise(text) if client else trimmed


def chat_role(role: Column, provider: str = "groq") -> Column:
    """Every role but the assistant's is the user's; one provider calls the assistant ``model``."""
    return F.when(role == "assistant", "model" if provider == "google" else "assistant").otherwise("user")


def conversation_title(text: Column) -> Column:
    """Collapsed; over 42 characters the first 42, trimmed, and an ellipsis."""
    flat = F.regexp_replace(F.regexp_replace(text, f"{JS_SPACE}+", " "), "^ | $", "")
    return F.when(F.length(flat) > 42, F.concat(F.trim(F.substring(flat, 1, 42)), F.lit("…"))).otherwise(flat)


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def word_count(text: Column) -> Column:
    """Words between JavaScript white space."""
    return F.size(F.array_remove(F.split(text, f"{JS_SPACE}+"), ""))  # far cheaper than matching a negated class


def render_inline(text: Column) -> Column:
    """Inline Markdown as HTML: code, bold, italic, links; the rest escaped.

    Code spans are put aside first, so that nothing in them is formatted; two double quotes,
    which escaped text and links never hold, keep their places.
    """
    escaped = escape_html(text)
    codes = F.regexp_extract_all(escaped, F.lit("`([^`]+)`"), F.lit(1))
    link = r'<a href="$2" target="_blank" rel="noreferrer">$1</a>'
    steps = [("`[^`]+`", '""'), (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"\*([^*]+)\*", "<em>$1</em>"), (r"\[([^\]]+)\]\((https?://[^)\s]+)\)", link)]
    parts = F.split(reduce(lambda t, step: F.regexp_replace(t, *step), steps, escaped), '""')
    spans = F.zip_with(codes, F.slice(parts, F.lit(2), F.size(codes)), lambda code, after: F.concat(F.lit("<code>"), code, F.lit("</code>"), after))
    return F.concat(parts[0], F.array_join(spans, ""))


def markdown_blocks(text: Column) -> Column:
    """The blocks of a Markdown text as an array of (kind, lines): fenced code (its language first),
    headings ``h2`` to ``h4``, lists ``ul`` and ``ol``, quotes, rules ``hr`` and paragraphs ``p``."""
    import pandas as pd

    marks = [("hr", re.compile(r"(-{3,})$")), ("h", re.compile(r"(#{1,4})\s+(.+)$")), ("ul", re.compile(r"[-*]\s+(.+)$")), ("ol", re.compile(r"\d+[.)]\s+(.+)$")), ("blockquote", re.compile(r">\s?(.+)$"))]
    fence = re.compile(r"```([A-Za-z0-9_+#.-]*)[ \t]*\n?(.*?)```", re.S)

    def kind_of(line: str) -> tuple[str, str]:
        for kind, pattern in marks:
            if found := pattern.match(line):
                return (f"h{min(len(found[1]) + 1, 4)}", found[2]) if kind == "h" else (kind, found[1])
        return ("p", line) if line else ("", "")

    def blocks(source: str) -> list[tuple[str, list[str]]]:
        out, joins = [], False
        pieces = fence.split(source.replace("\r\n", "\n"))  # text, language, code, text, ...
        for at in range(0, len(pieces), 3):
            for kind, content in map(kind_of, (line.strip() for line in pieces[at].split("\n"))):
                if joins and kind == out[-1][0] and kind in ("p", "ul", "ol"):
                    out[-1][1].append(content)
                elif kind:
                    out.append((kind, [] if kind == "hr" else [content]))
                joins = bool(kind)
            if at + 2 < len(pieces):
                code = pieces[at + 2]
                out.append(("code", [pieces[at + 1] or "code", code[code.startswith("\n") : len(code) - (code.endswith("\n") and len(code) > 1)]]))
                joins = False
        return out

    parsed = F.pandas_udf(lambda column: pd.Series([blocks(x or "") for x in column]), "array<struct<kind:string,lines:array<string>>>")
    return parsed(text)


#: What stands before a code block's language, between it and the code, and after that.  Fixed values.
CODE_BLOCK = (
    '''
    <div class="code-block">
      <div class="code-header">
        <span>''',
    '''</span>
        <button class="copy-code" type="button" data-copy-code>Copy</button>
      </div>
      <pre><code>''',
    '''</code></pre>
    </div>
  ''',
)


def render_markdown(text: Column) -> Column:
    """Markdown as HTML, block by block."""

    def tag(name, inner):
        return F.concat(F.lit("<"), name, F.lit(">"), inner, F.lit("</"), name, F.lit(">"))

    def html(block: Column) -> Column:
        kind, lines = block["kind"], block["lines"]
        items = F.array_join(F.transform(lines, lambda x: tag(F.lit("li"), render_inline(x))), "")
        before, between, after = CODE_BLOCK
        code = F.concat(F.lit(before), escape_html(lines[0]), F.lit(between), escape_html(F.try_element_at(lines, F.lit(2))), F.lit(after))
        return F.when(kind == "hr", F.lit("<hr>")).when(kind == "code", code).when(kind.isin("ul", "ol"), tag(kind, items)).otherwise(tag(kind, render_inline(F.array_join(lines, " "))))

    return F.array_join(F.transform(markdown_blocks(text), html), "")
