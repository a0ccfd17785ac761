"""Character classes that mean the same to Java's regular expressions and to RE2.

Both engines' own shorthands are narrower than Unicode, so white space, digits and word characters are spelled out.
"""

# Unicode white space, with the four separators of ASCII.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DECIMAL = r"\p{Nd}"
# Decimal digits, and the superscripts, subscripts and circled figures that also count as digits.
DIGIT = r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}"
WORD = r"\p{L}\p{N}_"
CJK = r"\x{4e00}-\x{9fff}"
#: Multi-line mode in which only a line feed ends a line.
LINES = "(?md)"
EDGES = rf"\A[{SPACE}]+|[{SPACE}]+\z"
