"""Text expressions: token estimates, fix text, snippets, spans and question routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AVG_FILE_TOKENS = 5000

# Question patterns of the graph tool, tried in order, first match wins.
GRAPH_INTENTS = [
    ("path", r"(what|which|show).*(connect|path|between|from).*\bto\b"),
    ("impact", r"(what|which).*(break|fail|affected|impact).*(if|when|changing?)"),
    ("dependency", r"(what|who).*(import|use|depend).*(on)"),
    ("centrality", r"(god|hotspot|central|most.connect|highest.blast)"),
    ("surprising", r"(surprising|unexpected|cross.module|strange)"),
    ("explain", r"(explain|describe|tell.*about|what.*is)\s+(.+)"),
    ("health", r"(health|quality|rating).*(worst|bad|poor|low)"),
    ("suggest", r"(suggest|recommend|question|what.*ask)"),
]

# Question patterns of the interactive prompt, tried in order.
PROMPT_INTENTS = [
    ("god nodes", r"god|hotspot|central|blast|connected"),
    ("surprising", r"surprising|unexpected|cross|strange"),
    ("questions / suggestions", r"question|suggest|recommend"),
    ("health / quality", r"health|quality|worst|bad|poor|rating"),
]


_W = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def ascii_words(pattern: str) -> str:
    """Spell out ``\\b`` for ASCII words; Java's own ``\\b`` also counts accented letters."""
    return pattern.replace(r"\b", _BOUNDARY)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def estimate_savings(files: Column, per_file: int = AVG_FILE_TOKENS) -> Column:
    return files * F.lit(per_file)


def percent(part: Column, total: Column) -> Column:
    """Whole percent, half up; null when there is nothing to divide by."""
    return F.when(total > 0, F.floor(part * 100 / total + 0.5))


def route_question(question: Column, intents=None) -> Column:
    """Name of the first matching intent, ``unrecognised`` for none."""
    out = None
    for name, pattern in intents or GRAPH_INTENTS:
        hit = F.rlike(F.trim(question), F.lit("(?i)" + ascii_words(pattern)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unrecognised")


def fix_text(fix_json: Column) -> Column:
    """Display text of a fix kept as text: the description of a JSON object, else the text itself."""
    obj = F.startswith(F.ltrim(fix_json), F.lit("{"))
    return F.when(obj, F.coalesce(F.get_json_object(fix_json, "$.description"), fix_json)).otherwise(fix_json)


def line_count(content: Column) -> Column:
    """Lines of a text, counting the empty one after a final newline."""
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def snippet(content: Column, line: Column, end_line: Column) -> Column:
    """Source lines around a span: one before it and one after it."""
    lines = F.split(content, "\n", -1)
    start = F.greatest(F.lit(0), line - 2)
    stop = F.least(F.size(lines), end_line + 1)
    return F.array_join(F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0))), "\n")


def offset_to_span(content: Column, offset: Column, length: Column) -> Column:
    """Line and column span of ``length`` characters at a 0-based offset."""
    before = F.split(F.substring(content, F.lit(1), offset), "\n", -1)
    inside = F.split(F.substring(content, offset + 1, length), "\n", -1)
    line = F.size(before)
    column = F.length(F.element_at(before, -1)) + 1
    return F.struct(
        line.alias("line"),
        column.alias("column"),
        (line + F.size(inside) - 1).alias("endLine"),
        F.when(F.size(inside) == 1, column + length)
        .otherwise(F.length(F.element_at(inside, -1)) + 1)
        .alias("endColumn"),
        offset.alias("offset"),
        length.alias("length"),
    )
