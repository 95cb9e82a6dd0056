"""License scans by canonical digests of whole texts.

A text is lower-cased, loses its copyright lines, has equivalent spellings made one, and every run
of punctuation and white space becomes a space. Two texts that differ only in these are the same
license, so the SHA-256 of the canonical text is looked up by a hash join among the digests of the
known texts, made the same way.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many known texts is broadcast.
MOST_BROADCAST = 50_000
COPYRIGHT = r"^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|©|[0-9])|\(c\) ?[0-9]|©|all rights reserved)[^\n]*$"
#: Equivalent spellings, as (pattern, replacement) with $1 for the part that stays.
SPELLINGS = (
    (r"licenc(e|es|ed|ing|ee|or|able)\b", "licens$1"),
    (r"\b(author|organ|util|recogn|initial|general|custom)is(e|es|ed|ing|ation)\b", "$1iz$2"),
    (r"\b(behavi|col|fav|hon)our", "$1or"),
    (r"\b(acknowledg|judg)ement", "$1ment"),
)
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{2010}-\x{201F}\x{2022}\x{2026}]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Known texts by name; notices of one line count as texts of their own.
TEXTS = (
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("Zlib", _ZLIB),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
)
#: Further short texts, with the headings that they may have.
_SHORT = (
    ("MIT", (_MIT,), ("MIT License", "The MIT License", "The MIT License (MIT)")),
    ("ISC", (_ISC, _ISC.replace("and/or distribute", "and distribute")), ("ISC License", "The ISC License", "ISC License (ISC)")),
    ("Zlib", (_ZLIB,), ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License")),
    ("BSD-2-Clause", (_BSD2 + _BSD_END,), ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", (_BSD2 + _BSD3 + _BSD_END,), ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License")),
)
#: Long texts, in files of these names, and the line that ends the terms or "" where nothing follows them.
_LONG = (
    ("Apache-2.0", "END OF TERMS AND CONDITIONS"),
    ("GPL-2.0", "END OF TERMS AND CONDITIONS"),
    ("GPL-3.0", "END OF TERMS AND CONDITIONS"),
    ("LGPL-2.1", "END OF TERMS AND CONDITIONS"),
    ("LGPL-3.0", ""),
    ("MPL-2.0", ""),
)
#: The first line of the terms, below titles and preambles.
_TERMS = r"(?m)^ *(?:TERMS AND CONDITIONS|0\. Additional Definitions|1\. Definitions)"
_ADDRESS = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_OLD_ADDRESS = "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"


def more_texts() -> list[tuple[str, str]]:
    """``(license, text)`` of further texts: with and without headings, appendices and filled-in names."""
    out = [("MIT notice", "Released under the MIT License.")]
    for name, texts, heads in _SHORT:
        holders = {u for t in texts for u in (t, t.replace("COPYRIGHT HOLDER OR", "COPYRIGHT HOLDERS OR"), t.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"))}
        out += [(name, f"{head}\n{t}") for t in holders for head in ("", *heads)]
    for name, end in _LONG:
        whole = (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")
        begin = re.search(_TERMS, whole).start()
        forms = {whole, whole[begin:]}
        forms |= {re.sub(r"(?m)^ *Copyright \[yyyy\].*$", "", t) for t in forms}
        forms |= {t[: t.index(end) + len(end)] for t in forms if end} | {t[: t.index(end)] for t in forms if end}
        forms |= {t.replace(_ADDRESS, _OLD_ADDRESS) for t in forms}
        forms |= {t.replace("http://", "https://") for t in forms} | {t.replace("https://", "http://") for t in forms}
        out += [(name, t) for t in sorted(forms)]
    return out


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), f"(?md){COPYRIGHT}", "")
    for pattern, replacement in SPELLINGS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.btrim(F.regexp_replace(out, PUNCTUATION, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_texts(spark: SparkSession) -> DataFrame:
    """``(license, text)`` of the texts above."""
    return spark.createDataFrame([*TEXTS, *more_texts()], "license string, text string")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, digest, license)``: the digest of each whole text, and the known text that has it.

    Only the digests are joined. Known texts are deduplicated by digest, the first name in order
    winning, and broadcast if they are at most ``MOST_BROADCAST``.

    Defined results: a null text has a null digest and no license; a text without letters or digits
    has the digest of the empty text and no license, even if a known text is empty too; a text of any
    length is read whole; repeated rows stay; an empty table gives an empty result; other columns are
    ignored, so their names can't clash.
    """
    names = known.select("license", digest(F.col("text")).alias("digest"), canonical(F.col("text")).alias("bare"))
    names = names.filter("bare <> '' and license is not null").groupBy("digest").agg(F.min("license").alias("license"))
    if names.count() <= MOST_BROADCAST:
        names = F.broadcast(names)
    found = docs.select(id_col, digest(F.col(text_col).cast("string")).alias("digest"))
    return found.join(names, "digest", "left").select(id_col, "digest", "license")


def _canonical_sql(column: str) -> str:
    out = f"regexp_replace(lower({column}), '(?m){COPYRIGHT}', '', 'g')"
    for pattern, replacement in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    return f"trim(regexp_replace({out}, '{PUNCTUATION}', ' ', 'g'))"


_ROWS = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in (*TEXTS, *more_texts()))
SCAN_SQL = f"""
WITH known(license, text) AS (VALUES {_ROWS}),
names AS (SELECT sha256({_canonical_sql("text")}) AS digest, min(license) AS license FROM known GROUP BY 1),
found AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, digest, license FROM found LEFT JOIN names USING (digest)
"""
