"""Licence scans by canonical digests: whole texts are normalised and hash-joined to known licences.

Normalising follows the usual matching rules: case, copyright lines, punctuation (quotes, dashes and marks alike),
white space and equivalent spellings make no difference. The digest of what remains is the join key, so a text matches
only as a whole. The built-in list holds short licences and notices; any table of further whole texts can be given. A
list of checked size is broadcast, so that documents stay where they are; a longer one meets their digests in a shuffle.

Defined cases: a null text counts as empty; texts that normalise to nothing match nothing; a null doc_id stays null;
rows with one doc_id, and equal rows, are each looked up; a digest with several names has the first by name; a text of
any length is normalised whole; other columns are ignored; an empty table gives an empty result. Only A to Z change
case, so that any SQL engine normalises alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings of short licences and notices, as published by their authors.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace(
    "\n\nTHIS SOFTWARE IS",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS",
)
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
MIT_0 = MIT.replace(
    """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    ".",
)
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = {
    "MIT": [MIT, f"MIT License\n\n{MIT}", f"The MIT License (MIT)\n\n{MIT}", "Released under the MIT License."],
    "MIT-0": [MIT_0, f"MIT No Attribution\n\n{MIT_0}"],
    "BSL-1.0": [BOOST, f"Boost Software License - Version 1.0 - August 17th, 2003\n\n{BOOST}"],
    "Unlicense": [UNLICENSE, UNLICENSE.replace("https://", "http://")],
    "ISC": [ISC, f"ISC License\n\n{ISC}"],
    "0BSD": [ZERO_BSD, f"BSD Zero Clause License\n\n{ZERO_BSD}"],
    "BSD-2-Clause": [BSD_2, f"BSD 2-Clause License\n\n{BSD_2}"],
    "BSD-3-Clause": [BSD_3, f"BSD 3-Clause License\n\n{BSD_3}"],
    "Zlib": [ZLIB, f"zlib License\n\n{ZLIB}"],
    "Apache-2.0": [APACHE_NOTICE, "Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
}
# Spellings that count as one, as words after punctuation became blanks.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("licencing", "licensing"),
    ("merchantibility", "merchantability"),
    ("modernisation", "modernization"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("practise", "practice"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that only say who holds the rights; a wrapped line may well begin with the word itself.
RIGHTS = r"(^|\n)[\x20\t]*(copyright[\x20\t]*(\(c\)|©|[0-9]|:|by[\x20\t])|\(c\)[\x20\t]*(copyright|[0-9])|©|all rights reserved)[^\n]*"
#: All of ASCII but digits and small letters, and typographic marks and white space beyond ASCII.
MARKS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{a0}\x{ab}\x{bb}\x{2010}-\x{201f}\x{2026}\x{2028}\x{2029}\x{202f}\x{3000}]+"


def _framed(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def canonical(text: F.Column) -> F.Column:
    """The text without what makes no difference; each word has a blank of its own on either side."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    plain = F.regexp_replace(F.regexp_replace(low, RIGHTS, "\n"), MARKS, "  ")
    framed = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    for other, usual in SPELLINGS:
        framed = F.replace(framed, F.lit(_framed(other)), F.lit(_framed(usual)))
    return framed


#: Listed texts up to which their digests are broadcast (some 120 bytes each).
BROADCAST_TEXTS = 100_000


def known(spark) -> DataFrame:
    """(license, text) of the built-in list."""
    return spark.createDataFrame([(name, text) for name, texts in KNOWN.items() for text in texts], "license string, text string")


def scan(documents: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_sha256, license): the digest of each canonical text, and the licence that it is, or null. `listed`:
    (license, text) of whole texts to look for; the built-in list if not given."""
    listed = known(documents.sparkSession) if listed is None else listed
    digests = listed.select("license", canonical(F.col("text")).alias("plain")).where("trim(plain) <> ''").groupBy(F.sha2("plain", 256).alias("text_sha256")).agg(F.min("license").alias("license"))
    digests = digests.hint("broadcast" if listed.count() <= BROADCAST_TEXTS else "merge")
    found = documents.select("doc_id", F.sha2(canonical(F.col("text").cast("string")), 256).alias("text_sha256"))
    return found.join(digests, "text_sha256", "left").select("doc_id", "text_sha256", "license")


def made_texts(customers: DataFrame) -> DataFrame:
    """(doc_id, text) for every customer: a licence of the built-in list in other case, spelling, punctuation or with a
    rights line, or with a word too many."""
    rows = customers.selectExpr("c_custkey AS doc_id", "c_name AS name")
    mit, isc, bsd = (F.lit(t) for t in (MIT, ISC, BSD_3))
    variants = [
        F.concat(F.lit("Copyright (c) 2020 "), F.col("name"), F.lit("\n\n"), mit),
        F.upper(isc),
        F.replace(bsd, F.lit('"AS IS"'), F.lit("``AS IS''")),
        F.concat(mit, F.lit(" "), F.col("name")),
        F.regexp_replace(F.lit(UNLICENSE), " ", "  \n"),
        F.lit(None).cast("string"),
    ]
    return rows.select("doc_id", F.element_at(F.array(*variants), (F.col("doc_id") % len(variants) + 1).cast("int")).alias("text"))


MADE_ORACLE = """
SELECT c_custkey AS doc_id, ['MIT', 'ISC', 'BSD-3-Clause', NULL, 'Unlicense', NULL][c_custkey % 6 + 1] AS license FROM customer
"""


def _canonical_sql(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    plain = f"regexp_replace(regexp_replace({low}, {quote(RIGHTS)}, chr(10), 'g'), {quote(MARKS)}, '  ', 'g')"
    framed = f"' ' || trim({plain}) || ' '"
    for other, usual in SPELLINGS:
        framed = f"replace({framed}, '{_framed(other)}', '{_framed(usual)}')"
    return framed


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({quote(name)}, {quote(text)})" for name, texts in KNOWN.items() for text in texts)
    return f"""
WITH listed(license, text) AS (VALUES {values}),
known AS (SELECT sha256({_canonical_sql("text")}) AS text_sha256, min(license) AS license FROM listed WHERE trim({_canonical_sql("text")}) <> '' GROUP BY 1),
docs AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS text_sha256 FROM documents)
SELECT doc_id, docs.text_sha256, license FROM docs LEFT JOIN known ON docs.text_sha256 = known.text_sha256
"""


ORACLE = _oracle()
