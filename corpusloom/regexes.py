"""Regular expressions in RE2 syntax, and their translation to Java's, which Spark uses.

The two dialects differ where it matters for Cyrillic text: RE2's ``\\b`` knows ASCII words only, its ``\\s`` lacks U+000B,
``.`` and multi-line anchors know no line end but ``\\n``, and ``$`` is the text's very end. ``java`` rewrites a pattern
so that Spark finds what RE2 finds; DuckDB takes the pattern as it stands.
"""

from __future__ import annotations

_SPACE = r"\t\n\f\r "
_WORD = "[0-9A-Za-z_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java(pattern: str) -> str:
    """An RE2 pattern as a Java pattern with the same matches."""
    multiline = pattern.startswith("(?m)")
    body = pattern.removeprefix("(?m)")
    out, in_class, i = [], False, 0
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            d = body[i + 1]
            i += 2
            if d == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif d == "S":
                out.append(f"[^{_SPACE}]")
            elif d == "b" and not in_class:
                out.append(_EDGE)
            else:
                out.append(c + d)
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "$" and not in_class and not multiline:
            out.append(r"\z")
            i += 1
            continue
        elif c in "[&" and in_class:  # these would start a nested class or an intersection
            out.append("\\")
        out.append(c)
        i += 1
    return ("(?dm)" if multiline else "(?d)") + "".join(out)


# The patterns and character ranges that define the cleaning and quality rules.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
HYPHEN_BREAK = r"(\p{L}+)-\s*\n\s*(\p{L}+)"
METADATA_LINE = r"(?m)^.*\b(?:ISBN|УДК|ББК|ISSN|DOI)\b.*$"
NUMBER_LINE = r"(?m)^\s*\d+\.?\s*$"
CONTENTS_NUMBER = r"([А-Яа-яЁё])(\d+)(?:\s|$)"
BIBLIOGRAPHIC = (r"[А-ЯЁ]\s+[ѴІ]\.\s*[А-ЯЁ]?\d+", r"[А-ЯЁ]{2,3}\s+[А-ЯЁ]?\.\d+", r"[А-ЯЁ]\.\s*\d+\.\d+")
SHAPES = r"[▲►▼◄■□▪▫●○◦★☆♦✓✗→←↑↓]"
RULER_LINE = r"(?m)^[=\-*_]{10,}$"
BLANKS = r"[ \t]+"
SPACE_BEFORE_MARK = r"\s+([.,!?;:])"
ISBN = r"\bISBN\s*\d{3}-\d{1,5}-\d{1,7}-\d{1,7}-\d{1,7}\b"
UDK = r"\bУДК\s*\d+(?:\.\d+)+\b"
BBK = r"\bББК\s*\d+(?:\.\d+)+\b"
URL = r"https?://[^\s]+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
LIST_MARKER = r"^\s*[•\-*•\d]+[\.\)]\s+"
CYRILLIC = r"[\x{0400}-\x{04FF}]"
LATIN = r"[A-Za-z]"
WORD = r"[А-Яа-яЁёA-Za-z]+(?:-[А-Яа-яЁёA-Za-z]+)*"
NOT_ACCEPTABLE = r"[^\n\r\t\x20-\x7E\x{0400}-\x{052F}\x{2E00}-\x{2E7F}—–…]"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
ROMAN_ITEM = r"^\s*[IVXLCDM]+[.)]\s+"
LETTER_ITEM = r"^\s*[A-Za-zА-Яа-я][.)]\s+"
BULLET_ITEM = r"^\s*[•\-*]\s+"
#: CJK blocks and Thai.
CJK_THAI_RANGES = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF),
    (0x2CEB0, 0x2EBEF), (0x30000, 0x3134F), (0x31350, 0x323AF), (0x2E80, 0x2EFF), (0x2F00, 0x2FDF), (0x2FF0, 0x2FFF),
    (0x3000, 0x303F), (0x31C0, 0x31EF), (0x3200, 0x32FF), (0x3300, 0x33FF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0x0E00, 0x0E7F),
)
CJK_THAI = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_THAI_RANGES) + "]"
#: A string that every match of a garbage pattern holds: looked for first, for it is found much faster.
GARBAGE_HINTS = {"isbn": "ISBN", "udk": "УДК", "bbk": "ББК", "url": "http", "email": "@"}
METADATA_HINT, HYPHEN_HINT = r"ISBN|УДК|ББК|ISSN|DOI", r"-\s*\n"
GARBAGE = {"isbn": ISBN, "udk": UDK, "bbk": BBK, "url": URL, "email": EMAIL}
SCRIPTS = {"cyrillic": CYRILLIC, "latin": LATIN}
SENTENCE_END = r"([.!?])[\t\n\f\r ]+"

# The same matches by Java's quickest means, for patterns that are tried at every character: single characters below 256 are one
# table, a lookahead at one range spares a long class, a run is tried from its beginning only, and what a replacement would not
# change is not matched. NUMBER_LINE_JAVA takes blank lines that no number follows, too, and gives them back as its group.
CONTROL_JAVA = "[" + "".join(rf"\x{c:02x}" for c in (*range(9), 11, 12, *range(14, 32), 127)) + "]"
HYPHEN_BREAK_JAVA = rf"(\p{{L}}(?<!\p{{L}}{{2}})\p{{L}}*+)-[{_SPACE}]*\n[{_SPACE}]*(\p{{L}}+)"
NUMBER_LINE_JAVA = rf"(?dm)^(?:[{_SPACE}]*+\d+\.?[{_SPACE}]*$|([{_SPACE}]++))"
CONTENTS_NUMBER_JAVA = rf"\d(?<=[А-Яа-яЁё]\d)\d*+(?:[{_SPACE}]|\z)"
BIBLIOGRAPHIC_JAVA = rf"[А-ЯЁ](?:[{_SPACE}]+[ѴІ]\.[{_SPACE}]*[А-ЯЁ]?\d|[А-ЯЁ][{_SPACE}]+[А-ЯЁ]?\.\d|\.[{_SPACE}]*\d+\.\d)"
SHAPES_JAVA = rf"(?=[\x{{2190}}-\x{{2717}}]){SHAPES}"
BLANKS_JAVA = r"[ \t](?:[ \t]++|(?<=\t))"
SPACE_BEFORE_MARK_JAVA = rf"[{_SPACE}](?<![{_SPACE}]{{2}})[{_SPACE}]*+([.,!?;:])"
#: WORD in a lower-cased text.
LOWER_WORD_JAVA = r"[a-zа-яё]++(?:-[a-zа-яё]++)*+"
