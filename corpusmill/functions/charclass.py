"""Character classes shared by the column functions and by the oracle SQL.

All are fixed values; both Java's and RE2's regular expressions take them.
"""

from __future__ import annotations

#: The 29 white-space characters of Python's str.split, as a class body.
SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Rule N1, annotation signs; N2, vowel signs; N3, elongation; N4, zero-width and direction signs.
ANNOTATION = r"\x{06D6}-\x{06ED}\x{0610}-\x{061A}"
VOWELS = r"\x{064B}-\x{065F}\x{0670}"
ELONGATION = r"\x{0640}"
ZERO_WIDTH = r"\x{200B}-\x{200F}\x{FEFF}\x{00AD}\x{202A}-\x{202E}"
#: Rule N6, letter by letter.
LETTERS_FROM = "أإآٱٲٳىةؤئ"
LETTERS_TO = "اااااايهوي"
#: Decimal digits, and what Python calls a digit beyond them.
DECIMAL = r"\p{Nd}"
DIGIT = (
    DECIMAL + r"\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}"
    r"\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}"
    r"\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)
#: Arabic-Indic, extended Arabic-Indic and Devanagari digits that a cast to a number does not read.
DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९"
DIGITS_TO = "0123456789" * 3


def sql_text(value: str) -> str:
    """A SQL string literal for DuckDB."""
    return "'" + value.replace("'", "''") + "'"
