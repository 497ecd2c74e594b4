"""Regular expressions, written in the subset that Java and RE2 read the same way.

Each chain is a list of ``(pattern, replacement)`` pairs with ``$1`` groups, applied in order.
No look-around, no ``\\b`` and no bare ``$``: those differ between the two dialects.
"""

# White space as Unicode text knows it (Java's and RE2's \s are ASCII only).
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
NOT_WS = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"
MARK = "\x01"
UNIT = "\x02"

WORD = r"[\p{L}\p{N}_]+"
STRIP = [(rf"\A{WS}+", ""), (rf"{WS}+\z", "")]

CLEAN = STRIP + [
    (r"\r", ""),
    (r"[#*]", ""),
    (r"``|''|“|”", '"'),
    (r'""', '"'),
    (rf'([.,?!:;"]){WS}*([.,?!:;"])', "$1"),
    (rf"{WS}+([.,?!:;])", "$1"),
] + STRIP

# A sentence ends at . ? or ! plus closing marks; titles and single initials do not end one.
SENTENCE_BREAKS = [
    (r"[\x01\x02]", " "),
    (rf"([.?!][\"”’)\]]*){WS}+({NOT_WS})", "$1" + MARK + "$2"),
    (
        rf"(\A|[\s\x01\p{{Z}}(\"])((?:\p{{L}}|[Mm]rs?|[Mm]s|[Dd]r|[Pp]rof|[Ss]t|[JjSs]r|[Ee]tc"
        rf"|[Ii]\.e|[Uu]\.[Ss])\.)\x01({NOT_WS})",
        "$1$2 $3",
    ),
]
# The same breaks, with the white space kept, so that the pieces add up to the text.
SENTENCE_SPANS = [
    (r"[\x01\x02]", " "),
    (rf"([.?!][\"”’)\]]*)({WS}+{NOT_WS})", "$1" + MARK + "$2"),
    (
        rf"(\A|[\s\x01\p{{Z}}(\"])((?:\p{{L}}|[Mm]rs?|[Mm]s|[Dd]r|[Pp]rof|[Ss]t|[JjSs]r|[Ee]tc"
        rf"|[Ii]\.e|[Uu]\.[Ss])\.)\x01({WS}+{NOT_WS})",
        "$1$2$3",
    ),
]

# Word tokens: pad marks with blanks, then split on white space. MARK separates sentences.
TOKEN_PADDING = [
    (r"(\A|[\s\x01\p{Z}(\[{<])\"", "$1 `` "),
    (r'"', " '' "),
    (r"([–—“”‘’«»*])", " $1 "),
    (r"([;@#$%&?!])", " $1 "),
    (r"([:,])([^0-9]|\z)", " $1 $2"),
    (r"([()\[\]{}<>])", " $1 "),
    (r"(--|…|\.\.+)", " $1 "),
    (r"([^.\s\x01\p{Z}])(\.)([\s\p{Z}]*[\"')\]]*[\s\p{Z}]*)(\x01|\z)", "$1 $2 $3$4"),
    (r"([\p{L}\p{N}_])([nN]'[tT])([^\p{L}\p{N}_]|\z)", "$1 $2$3"),
    (r"([^'\s\p{Z}\x01])('[sSmMdD]|'[rR][eE]|'[vV][eE]|'[lL][lL])([^\p{L}\p{N}_]|\z)", "$1 $2$3"),
    (r"([^'\s\p{Z}\x01])(')([\s\x01\p{Z}]|\z)", "$1 $2$3"),
]

SLUG = STRIP + [
    (r"[\n\r\t]+", ""),
    (r"['\"]", ""),
    (r"[^\p{L}\p{N}_\-.]", "_"),
    (r"_+", "_"),
    (r"\A_+", ""),
    (r"_+\z", ""),
]

# Literal replacements, in order.
DETOK_SPACED = [
    (" .", "."), (" ,", ","), (" ?", "?"), (" !", "!"), ("``", '"'), ("''", '"'), ("#", ""),
    ("*", ""),
]
DETOK_DOUBLED = [
    (" . . ", ". "), (" , , ", ", "), (" ? ? ", "? "), (" ! ! ", "! "), (" ? ", "? "),
    (" ! ", "! "), ("``", '"'), ("''", '"'), ('""', '"'), ("#", ""), ("*", ""),
]

# Source text. STR is a quoted literal on one line.
STR = r""""(?:\\[^\n]|[^"\\\n])*"|'(?:\\[^\n]|[^'\\\n])*'"""
MASK_C = [
    (rf"({STR})|/\*(?:[^*]|\*+[^*/])*\*+/|//[^\n]*", "$1"),
    (STR, '""'),
    (r"(?m)^[ \t]*#[^\n]*", ""),
]
MASK_PY = [
    (r'"""(?:[^"]|"[^"]|""[^"])*"""|' + r"'''(?:[^']|'[^']|''[^'])*'''", '""'),
    (rf"({STR})|#[^\n]*", "$1"),
    (STR, '""'),
]
MASK_HTML = [(r"<!--(?:[^-]|-[^-]|--[^>])*-->", "")]

COMMENTS_C = [(rf"({STR})|/\*(?:[^*]|\*+[^*/])*\*+/|//[^\n]*", "$1")]
COMMENTS_PY = [(rf"({STR})|#[^\n]*", "$1")]
COMMENTS_HTML = MASK_HTML

CODE_TOKEN = (
    r"\"\"|[\p{L}_][\p{L}\p{N}_]*|[0-9][0-9A-Za-z.]*|&&|\|\||==|!=|<=|>=|\+\+|--|->|\+=|-=|\*=|/=|<<|>>|::"
    r"|[^\s\p{L}\p{N}_]"
)
PREPROCESSOR_LINE = r"(?m)^[ \t]*#[^\n]*"
RANGE_FOR = r"\bfor[ \t]*\([^;()]*(?:\([^()]*\))?[^;()]*:[^;:]"
# Directives that count as a token but not as a line of code.
UNCOUNTED_LINE = r"\A[ \t]*#[ \t]*(?:define|undef|pragma)"
PY_DEF = r"\A[ \t]*(?:async[ \t]+)?def[ \t]"
PY_DECISION = r"\b(?:if|elif|for|while|and|or|except|assert|finally)\b"
C_FUNCTION = (
    r"(?:\boperator[ \t]*(?:\(\)|[^\s\p{L}\p{N}_(]+)|[\p{L}_][\p{L}\p{N}_]*)[ \t]*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)"
    r"[\s]*(?:const|override|noexcept)?[\s]*(?::[^;{}]*)?\{"
)
C_BLOCK_HEAD = (
    r"\b(?:if|for|while|switch|catch)[ \t]*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)"
    r"[\s]*\{"
)
ASSIGNED_NAME = r"([\p{L}_][\p{L}\p{N}_]*)[ \t]*(?:\[[^\]\n]*\])?[ \t]*=[^=]"
TAG = r"</?[A-Za-z][^<>]*>"
ATTRIBUTE = r"[\s]([A-Za-z][A-Za-z0-9_:\-]*)="
VOID_TAGS = "area base br col embed hr img input link meta source track wbr".split()
