"""Text column expressions: case/accent folding, tokens, statistics.

Everything here returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of letters and digits, and marks after them (after folding);
# punctuation, symbols, whitespace and '_' separate tokens.
TOKEN_PATTERN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


# Combining marks that are diacritics of any script; other marks (vowel signs
# of Indic scripts, points of Hebrew and Arabic) belong to the word and stay.
DIACRITICS = r"[\u0300-\u036F\u1AB0-\u1AFF\u1DC0-\u1DFF\u20D0-\u20FF\uFE20-\uFE2F]+"


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: letters whose full canonical
    decomposition is a letter and diacritics fold to that letter.

    Built from the Unicode database by rule for all code points of the basic
    plane; letters that ASCII digits or letters do not begin keep their script.
    """
    src, dst = [], []
    marks = re.compile(DIACRITICS)
    for cp in range(0x00C0, 0x10000):
        ch = chr(cp)
        whole = unicodedata.normalize("NFD", ch)
        if len(whole) > 1 and whole[0].isalpha() and marks.fullmatch(whole[1:]):
            base = whole[0]
            src.append(ch)
            dst.append(base.lower() if ch.islower() else base)
    return "".join(src), "".join(dst)


def fold(c: Column | str) -> Column:
    """Lower-case, strip diacritics, fold accented letters (a text of one-byte characters has none of these)."""
    c = F.col(c) if isinstance(c, str) else c
    src, dst = accent_table()
    no_marks = F.regexp_replace(F.lower(c), DIACRITICS, "")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(no_marks, src, dst))


def tokens(c: Column | str) -> Column:
    """ARRAY<STRING> of folded tokens, in text order (position = index)."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN_PATTERN), 0)


def raw_tokens(c: Column | str) -> Column:
    """Tokens with their original spelling; folded one by one they are :func:`tokens`."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def fold_py(s: str) -> str:
    """Driver-side twin of :func:`fold` for query strings (not for data)."""
    src, dst = accent_table()
    s = re.sub(DIACRITICS, "", s.lower())
    return s.translate(str.maketrans(src, dst))


def tokens_py(s: str) -> list[str]:
    """Driver-side tokenizer for query strings; same rule as :func:`tokens`."""
    out, word = [], ""
    for ch in fold_py(s) + " ":
        kind = unicodedata.category(ch)[0]
        if kind in "LN" or word and kind == "M":
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def ascii_lower(c: Column | str) -> Column:
    """Lower-case ASCII letters only (the case rule of SQL LIKE matching)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower_py(s: str) -> str:
    """Driver-side twin of :func:`ascii_lower` for query strings."""
    return s.translate(str.maketrans(_UPPER, _LOWER))


def glob_to_regex(pattern: str) -> str:
    """fnmatch-style glob ('*', '?', '[seq]', '[!seq]') to an anchored regex."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = i
            if j < n and pattern[j] in "!^":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                out.append("\\[")
            else:
                body = pattern[i:j].replace("\\", "\\\\")
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body + "]")
                i = j + 1
        else:
            out.append("\\" + ch if not ch.isalnum() else ch)
    return "(?s)^" + "".join(out) + "$"


#: What surrounds a hit in a snippet.
MARKS = (">>>", "<<<")


def snippet_markup(snippet: Column | str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """A snippet as markup: its text escaped, its hit marks replaced by tags."""
    s = F.col(snippet) if isinstance(snippet, str) else snippet
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(c), F.lit(name))
    for mark, tag in zip(MARKS, (before, after)):
        s = F.replace(s, F.lit(mark.replace("<", "&lt;").replace(">", "&gt;")), F.lit(tag))
    return s


_CODE = r"(?s)```python\s*\n(.*?)```"


def first_code_block(c: Column | str) -> Column:
    """Text of the first fenced python block without white space around it; null if there is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(_CODE), F.regexp_replace(F.regexp_extract(c, _CODE, 1), r"^\s+|\s+$", ""))


def tags_with(fixed: Column, extra: Column) -> Column:
    """Fixed tags with those of an array after them, trimmed, blank ones left out."""
    listed = F.filter(F.transform(extra, lambda t: F.trim(t)), lambda t: t != "")
    return F.concat(fixed, F.when(F.size(listed) > 0, F.concat(F.lit(","), F.array_join(listed, ","))).otherwise(F.lit("")))


def text_stats(c: Column | str) -> dict[str, Column]:
    """Line/word/char counts, first five lines, 300-char preview, >50,000 flag."""
    c = F.col(c) if isinstance(c, str) else c
    lines = F.split(F.trim(c), "\n")
    return {
        "lines": F.size(lines).cast("long"),
        "words": F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("long"),
        "chars": F.length(c).cast("long"),
        "first_lines": F.array_join(F.slice(lines, 1, 5), "\n"),
        "preview": F.when(F.length(c) > 300, F.concat(F.substring(c, 1, 300), F.lit("...")))
                    .otherwise(c),
        "too_big": F.length(c) > 50000,
    }
