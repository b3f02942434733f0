"""License scans by canonical digest.

A text is put in canonical form (lower case, no punctuation, no copyright lines, equivalent spellings
made one, single spaces) and its digest joined with the digests of known licences. The whole text of
a document is looked up, and each of its lines as a notice of its own.

Only lines whose canonical length is that of a known text are hashed and joined; no other can match.
Null and empty texts have an empty canonical form and match nothing, like texts of copyright lines
alone. Repeated rows each get a row; known licences that share a canonical text are all named.

The known set is ``KNOWN`` (short texts and notices) and the whole texts in ``license_texts/``, with
and without their titles and appendices, as wrapped there and with one line a paragraph.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.frames import keyed_texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = r"[^\n0-9a-z\x{80}-\x{10FFFF}]+"
COPYRIGHT = r"(^|\n) ?(copyright|c copyright|© |all rights reserved)[^\n]*"

# Spellings that count as equal, applied in this order to text without punctuation.
EQUIVALENT = (
    ("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("authoris", "authoriz"),
    ("recognis", "recogniz"), ("initialis", "initializ"), ("utilis", "utiliz"), ("favour", "favor"), ("honour", "honor"),
    ("labour", "labor"), ("behaviour", "behavior"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"),
    ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"), ("non commercial", "noncommercial"),
    ("artefact", "artifact"), ("analogue", "analog"), ("catalogue", "catalog"), ("centre", "center"), ("https ", "http "),
)

# Known licence texts and notices.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AUTHOR = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = (
    ("MIT", "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a "
     'copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
     "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe "
     "above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
     + _WARRANTY),
    ("ISC", "ISC License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any "
     "purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
     "all copies.\n\n" + _AUTHOR),
    ("0BSD", "Copyright (C) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted.\n\n" + _AUTHOR),
    ("Zlib", "Copyright (c) <year> <holder>\n\nThis software is provided 'as-is', without any express or implied warranty. In no event "
     "will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to "
     "use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
     "the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote "
     "the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
     "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented "
     "as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
)

# Titles that may stand above a text; those of texts not named here are in their file.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "The BSD License",
                     'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "The BSD License", "New BSD License", "Modified BSD License",
                     'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Paragraphs of the title, where a file has more than one.
TITLE_PARAGRAPHS = {"CC0-1.0": 2}
#: Last line of the terms, after which an appendix on their use may be left out.
END_OF_TERMS = r"(?i)\n *(END OF TERMS AND CONDITIONS|Exhibit A - Source Code Form License Notice)[^\n]*"
#: Wordings of one licence: pairs of a wording and others that stand in its place.
WORDINGS = (
    ("COPYRIGHT\nHOLDER OR CONTRIBUTORS BE", ("COPYRIGHT OWNER OR CONTRIBUTORS BE",)),
    ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", ("59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",)),
    ("modify, and/or distribute", ("modify, and distribute",)),
)


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of whole licence texts, in the variants that are looked up."""
    files = [(f.name.removesuffix(".txt").split("~")[0], f.read_text("utf-8").strip("\n")) for f in resources.files("folioscope.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")]
    found = set()
    for name, text in [*files, *((n, t) for n, t in KNOWN if "\n\n" in t)]:
        paragraphs = re.split(r"\n\s*\n", text)
        own = TITLES.get(name, ())
        if not own:
            heads = range(TITLE_PARAGRAPHS.get(name, 1) + 1)
            starts = ["\n\n".join(paragraphs[n:]) for n in heads]
        else:
            body = "\n\n".join(paragraphs[1:] if paragraphs[0].strip() in own else paragraphs)
            starts = [body, *(f"{title}\n\n{body}" for title in own)]
        for whole in starts:
            ended = re.split(END_OF_TERMS, whole, maxsplit=1)
            forms = [whole] if len(ended) == 1 else [whole, ended[0], *([f"{ended[0]}\n{ended[1]}"] if ended[1].startswith("END") else [])]
            forms += [f.replace(a, b) for f in forms for a, others in WORDINGS for b in others if a in f]
            forms += [re.sub(r"(?m)^ *[1-4][.)] ", " * ", f) for f in forms if name.startswith("BSD")]
            forms += ["\n\n".join(re.sub(r"\s*\n\s*", " ", p) for p in re.split(r"\n\s*\n", f)) for f in forms]
            found.update((name, f) for f in forms)
    return sorted(found)


def canonical_lines(text: Column) -> Column:
    """Canonical form with line breaks kept."""
    out = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), MARKS, " ")
    out = F.regexp_replace(out, COPYRIGHT, "$1")
    for spelling, same in EQUIVALENT:
        out = F.replace(out, F.lit(spelling), F.lit(same))
    return out


def canonical(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_licenses(spark: SparkSession, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(license, digest, length) of the known texts; rows without text after normalisation are left out."""
    rows = spark.createDataFrame([*KNOWN, *whole_texts()] if known is None else list(known), "license string, text string")
    form = rows.select("license", canonical(canonical_lines(F.col("text"))).alias("form")).where("form != ''")
    return form.select("license", F.sha2("form", 256).alias("digest"), F.length("form").alias("length")).distinct()


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, digest, licenses (of the whole text), notices (of whole lines), as sorted arrays."""
    known = known if known is not None else known_licenses(docs.sparkSession)
    keyed = keyed_texts(docs, id_column, text_column)
    lengths = [r["length"] for r in known.select("length").distinct().collect()]  # few: one a known text
    forms = keyed.select("k1", "k2", "doc_id", canonical_lines(F.col("text")).alias("lines"))
    wanted = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    own = forms.select(
        "k1", "k2", "doc_id", F.sha2(canonical(F.col("lines")), 256).alias("digest"),
        F.array_distinct(F.filter(F.transform(F.split("lines", "\n"), canonical), lambda l: F.array_contains(wanted, F.length(l)))).alias("held"))
    named = known.groupBy("digest").agg(F.array_sort(F.collect_set("license")).alias("licenses"))
    notices = (
        own.select("k1", "k2", F.explode("held").alias("line")).select("k1", "k2", F.sha2("line", 256).alias("digest")).distinct()
        .join(known.select("digest", "license"), "digest")
        .groupBy("k1", "k2").agg(F.array_sort(F.collect_set("license")).alias("notices")))
    none = F.array().cast("array<string>")
    return own.drop("held").join(named, "digest", "left").join(notices, ["k1", "k2"], "left").select(
        "doc_id", "digest", F.coalesce("licenses", none).alias("licenses"), F.coalesce("notices", none).alias("notices"))
