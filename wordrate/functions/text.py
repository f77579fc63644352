"""Text Column expressions: quoted-word extraction, answer parsing, templates.

All functions return ``pyspark.sql.Column`` objects built from built-in functions so
they stay inside whole-stage code generation; nothing here is a Python UDF.
Regular expressions are Java regexes; ``(?U)`` makes ``\\s`` / ``\\d`` Unicode-aware,
which is how Python's ``re`` treats them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ascii_digits

# --- fixed values: quote characters and JSON labels per language -----------------
# English defaults, and the German variant (low-9 opening quote, right closing quote).
LOCALES = {
    "default": {"open": '"', "close": '"', "word_label": "Word", "feature_label": "AoA"},
    "german": {"open": "„", "close": "”", "word_label": "Wort", "feature_label": "Erwerbsalter"},
}
# Answer patterns ({label} is the JSON label, quoted literally):
#   value of the label in quotes, value of the label bare, the word of the word label,
#   and signed number forms searched anywhere (fraction with leading dot, number with
#   trailing dot, integer), in this order of preference.
LABEL_QUOTED_VALUE = r'"{label}"\s*:\s*"([0-9]*\.?[0-9]+)"'
LABEL_BARE_VALUE = r'"{label}"\s*:\s*([0-9]*\.?[0-9]+)'
LABEL_WORD = r'"{label}"\s*:\s*"([^"]+)"'
NUMBER_ANYWHERE = r"[-+]?\d*\.\d+|[-+]?\d+\.\d*|[-+]?\d+"
# --------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _java_quote(s: str) -> str:
    # \Q...\E literal quoting, safe for any label text
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _quoted_run(open_q: str, close_q: str) -> str:
    # (?d): only "\n" ends a line for ".", as in Python's re (Java would also stop at
    # "\r", NEL and the Unicode line/paragraph separators)
    return "(?d)" + _java_quote(open_q) + "(.*?)" + _java_quote(close_q)


def first_quoted(text, open_q: str = '"', close_q: str = '"') -> Column:
    """First non-greedy quoted run on one line; NULL when there is none."""
    pat = _quoted_run(open_q, close_q)
    return F.try_element_at(F.regexp_extract_all(_col(text), F.lit(pat), 1), F.lit(1))


def last_quoted(text, open_q: str = '"', close_q: str = '"') -> Column:
    """Last quoted run; NULL when there is none or it is empty."""
    pat = _quoted_run(open_q, close_q)
    return F.nullif(F.try_element_at(F.regexp_extract_all(_col(text), F.lit(pat), 1), F.lit(-1)), F.lit(""))


def word_from_answer(text, label: str = "Word") -> Column:
    """Value of ``"<label>" : "<non-empty>"`` in a JSON-ish answer, else NULL."""
    pat = "(?U)" + LABEL_WORD.replace('"{label}"', '"' + _java_quote(label) + '"')
    return F.nullif(F.regexp_extract(_col(text), pat, 1), F.lit(""))


def number_from_answer(text, label: str) -> Column:
    """Three tiers -- quoted value of the label, bare value of the label, else the
    last signed number anywhere in the text; NULL if none.  Result is double."""
    t = F.coalesce(_col(text), F.lit(""))
    q = '"' + _java_quote(label) + '"'
    tier1 = F.nullif(F.regexp_extract(t, "(?U)" + LABEL_QUOTED_VALUE.replace('"{label}"', q), 1), F.lit(""))
    tier2 = F.nullif(F.regexp_extract(t, "(?U)" + LABEL_BARE_VALUE.replace('"{label}"', q), 1), F.lit(""))
    tier3 = F.try_element_at(F.regexp_extract_all(t, F.lit("(?U)" + NUMBER_ANYWHERE), 0), F.lit(-1))
    raw = F.coalesce(tier1, tier2, tier3)
    return ascii_digits(raw).try_cast("double")


def placeholder_key(prompt) -> Column:
    """Text from the first ``"{`` to the next ``}"`` with braces, quotes dropped."""
    return F.nullif(F.regexp_extract(_col(prompt), "(?s)\"(\\{.*?\\})\"", 1), F.lit(""))


def column_placeholder(column_name: str) -> Column:
    """P5: placeholder made from the column name."""
    return F.lit("{" + column_name + "}")


def as_text(value) -> Column:
    """Stringify a cell the way a pandas cell prints: missing becomes ``nan``."""
    return F.coalesce(_col(value).cast("string"), F.lit("nan"))


def fill_template(template, key, word) -> Column:
    """Literal replacement of every occurrence of ``key`` by the word text."""
    return F.replace(_col(template), _col(key), as_text(word))


_PARTIAL = re.compile(r"{(\w+)}")


def partial_template(template: str, columns: Mapping[str, Column] | list[str], match: str = "casefold") -> Column:
    """Fill ``{name}`` slots of a constant template from row columns.

    The template is a constant, so it is split once here and becomes a ``concat`` of
    literals and columns.  ``match="reference"`` looks a slot up by its lower-cased
    name among the exact column names (``{Word}`` does not find a column ``Word``);
    ``match="casefold"`` compares both sides lower-cased.  Unknown slots stay as text.
    """
    if not isinstance(columns, Mapping):
        columns = {c: F.col(c) for c in columns}
    if match == "reference":
        lookup = dict(columns)
    elif match == "casefold":
        lookup = {}
        for name, c in columns.items():
            lookup.setdefault(name.lower(), c)
    else:
        raise ValueError(f"unknown match rule {match!r}")
    parts: list[Column] = []
    pos = 0
    for m in _PARTIAL.finditer(template):
        key = m.group(1).lower()
        if key in lookup:
            if m.start() > pos:
                parts.append(F.lit(template[pos:m.start()]))
            parts.append(as_text(lookup[key]))
            pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    if not parts:
        return F.lit("")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def short_name(name) -> Column:
    """Text before the first ``_`` when that position (0-based) is above 1."""
    n = _col(name)
    pos = F.instr(n, "_")  # 1-based, 0 when absent
    return F.when(pos > 2, F.substring_index(n, "_", 1)).otherwise(n)


def short_name_of(name: str) -> str:
    """P14 for a constant experiment name (used to name output columns)."""
    pos = name.find("_")
    return name[:pos] if pos > 1 else name


def sentinel(value, missing: str = "#N/D") -> Column:
    """Missing cells rendered as a sentinel text (for sinks only)."""
    c = _col(value)
    return F.coalesce(c.cast("string"), F.lit(missing))


def missing_or_blank(*cols, types: Mapping[str, str] | None = None) -> Column:
    """Any of the columns is NULL, NaN (numeric) or blank after trimming (text)."""
    conds = []
    for c in cols:
        name = c if isinstance(c, str) else None
        col = _col(c)
        dtype = (types or {}).get(name, "string") if name else "string"
        if dtype in ("double", "float"):
            conds.append(col.isNull() | F.isnan(col))
        elif dtype == "string":
            conds.append(col.isNull() | (F.trim(col) == F.lit("")))
        else:
            conds.append(col.isNull())
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def cell_label(r) -> Column:
    """Two decimals or ``-`` for a missing value."""
    return F.coalesce(F.format_number(_col(r), 2), F.lit("-"))


def first_char_int(text) -> Column:
    """The first character of the answer as an integer, else NULL ('N/D')."""
    ch = F.substring(_col(text), 1, 1)
    return F.when(ch.rlike("(?U)^\\d$"), ascii_digits(ch).try_cast("int"))


def json_field(text, path: str, type_: str = "string") -> Column:
    """X25 for layouts without a fixed schema: parse as VARIANT and read one path;
    malformed text or a missing / mistyped field gives NULL."""
    return F.try_variant_get(F.try_parse_json(_col(text)), path, type_)
