"""The patterns of structured entities in Java's dialect.

`(?U)` gives \\w, \\d, \\s and \\b their Unicode meaning, `(?d)` leaves the line feed as the only line end.
"""

EMAIL = r"(?U)(?<![/@\w])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+(?![.\w])"
PHONE_INTERNATIONAL = r"(?U)(?<!\d)\+\d{1,3}[\s\-\.]?\(?\d{1,5}\)?[\s\-\.]\d{3,5}[\s\-\.]\d{4,5}(?!\d)"
PHONE_TEN_DIGITS = r"(?U)(?<!\d)[6-9]\d{9}(?!\d)"
PHONE_US = r"(?U)(?<!\d)(?:\(\d{3}\)|\d{3})[\s\-\.]\d{3}[\s\-\.]\d{4}(?!\d)"
IP = r"(?U)(?<!\d\.)(?<!\d)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.\d)(?!\d)"
CARD = r"(?U)(?<!\d)(?:\d[ \-]?){13,19}\d(?!\d)"
SSN = r"(?U)(?<!\d)(?!000)(?!666)(?!9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!\d)"
SSN_CONTEXT = r"(?iUd)\b(?:SSN|Social Security(?: Number)?|Tax ID)\b"

MONTH = (
    "(?:January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
)
DATES = (
    r"(?U)\b\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}\b",
    rf"(?iU)\b{MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"(?iU)\b\d{{1,2}}\s+{MONTH}\.?\s+\d{{4}}\b",
    r"(?U)\b\d{4}[-\/]\d{2}[-\/]\d{2}\b",
)
BIRTH_CONTEXT = r"(?iUd)\b(?:DOB|D\.O\.B\.?|Date\s+of\s+Birth|Birth\s*Date|Birthdate|Born|born\s+on)\b"

ADDRESS_KEYWORD = (
    r"(?iU)\b(?:street|road|avenue|lane|plot|flat|floor|building|nagar|sector|colony|taluka|district|village|pin|zip"
    r"|postal|po\s+box|p\.o\.\s*box|phase|block|wing|industrial\s+estate|office|suite|unit)\b"
)
POSTAL = r"(?U)\b\d{6}\b|\b\d{5}(?:[-\s]\d{4})?\b"

#: The forms that the queries' SQL states, as (before, span, behind): RE2 has no look-around, so spans are framed by the
#: characters beside them, and its digits and blanks are those of ASCII.
LETTER = r"\p{L}\p{N}_"
FRAMED_EMAIL = (rf"^|[^/@{LETTER}]", rf"[{LETTER}.+\-]+@[{LETTER}\-]+(?:\.[{LETTER}\-]+)+", rf"[^.{LETTER}]|\z")
FRAMED_IP = (r"^|[^\d.]|\D\.", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", r"\z|[^\d.]|\.\D|\.\z")
GAP = r"[\t\n\f\r \-.]"
FRAMED_INTERNATIONAL = (r"^|\D", rf"\+\d{{1,3}}{GAP}?\(?\d{{1,5}}\)?{GAP}\d{{3,5}}{GAP}\d{{4,5}}", r"\z|\D")
FRAMED_US = (r"^|\D", rf"(?:\(\d{{3}}\)|\d{{3}}){GAP}\d{{3}}{GAP}\d{{4}}", r"\z|\D")
FRAMED_CARD = (r"^|\D", r"(?:\d[ \-]?){13,19}\d", r"\z|\D")
