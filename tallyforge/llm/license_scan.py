"""License scans: canonical digests of entire texts (and of each line as a notice), hash-joined to known licences.

Canonical form: lower case; copyright lines dropped; punctuation and white space to one space; equivalent spellings to
one; blank lines dropped; lines joined by a space. The SHA-256 of that form meets the digests of known licence texts.

Defined results. Null text: null digest, no licence, no notices. Empty text, or one of copyright lines only: the digest
of the empty string, no licence. Repeated rows: one result each. Empty table: no rows. Ties: a digest known under two
ids gives the smaller one. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if

#: Up to this many known digests (about 100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_DIGESTS = 500_000

# A copyright line, where "(c)" alone may be a clause's letter; punctuation and white space apart from line ends; spellings held to be equivalent.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)[ \t]*(?:[0-9]{4}|copyright|by )|\x{A9}|all rights reserved)[^\n]*"
NOT_WORD = r"[\x{0}-\x{9}\x{B}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{BF}\x{2000}-\x{206F}\x{FEFF}]+"
SPELLINGS = (
    ("licen[cs]e", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("fulfilment", "fulfillment"),
    ("version ([0-9])", r"v\1"),
    (r"\bv ([0-9])", r"v\1"),
)

# Public licence texts, and the names that short notices use.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BSD_3 = BSD_2.replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE")
#: Long texts, as files named by their ids; with "END OF TERMS AND CONDITIONS", what stands before it is known as well, with and without that line.
WHOLE, LAST = Path(__file__).with_name("licenses"), "END OF TERMS AND CONDITIONS"
TEXTS = {"MIT": (MIT, "MIT License\n" + MIT), "ISC": (ISC, "ISC License\n" + ISC), "BSD-2-Clause": (BSD_2,), "BSD-3-Clause": (BSD_3,), "Zlib": (ZLIB,)}
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0"),
    "MIT": ("the MIT License", "MIT License"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPL v3"),
    "GPL-2.0": ("the GNU General Public License, version 2",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0",),
    "CC-BY-4.0": ("CC BY 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
}
VERBS = ("Licensed under", "Released under", "This work is licensed under", "This software is released under", "Distributed under")


def known_licenses() -> list[tuple[str, str]]:
    """(id, text): whole licence texts, and each notice that a verb and a name make."""
    whole = [(k, t) for k, texts in TEXTS.items() for t in texts]
    for path in sorted(WHOLE.glob("*.txt")):
        text = path.read_text()
        terms, line, _ = text.partition(LAST)
        whole += [(path.stem, t) for t in dict.fromkeys((text, terms, terms + line))]
    return whole + [(k, f"{verb} {name}.") for k, names in NAMES.items() for name in names for verb in VERBS]


def canonical_lines(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1"), NOT_WORD, " ")
    for spelling, one in SPELLINGS:
        out = F.regexp_replace(out, spelling, one.replace("\\1", "$1"))
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def license_scan(docs: DataFrame, known: DataFrame | Mapping[str, str] | None = None) -> DataFrame:
    """docs(doc_id, text) and known(license, text) -> doc_id, text_sha256, license, n_notices (lines), notices (distinct ids)."""
    spark = docs.sparkSession
    if known is None or isinstance(known, Mapping):
        known = spark.createDataFrame([*(known_licenses() if known is None else known.items())], "license string, text string")
    digests = (
        known.select("license", F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest"))
        .where(F.col("digest") != F.sha2(F.lit(""), 256))
        .groupBy("digest").agg(F.min("license").alias("found"))
    )
    small = known.count() <= BROADCAST_DIGESTS
    unit = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.sha2(F.array_join("_lines", " "), 256).alias("digest"))),
        F.coalesce(F.transform("_lines", lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(x, 256).alias("digest"))), F.array().cast("array<struct<whole:boolean,digest:string>>")),
    )
    units = (
        docs.select("doc_id", canonical_lines(F.col("text")).alias("_lines"))
        .withColumn("_row", F.monotonically_increasing_id())
        .select("_row", "doc_id", F.inline(unit))
    )
    met = units.join(broadcast_if(small, digests), "digest", "left").where(F.col("whole") | F.col("found").isNotNull())
    return met.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("text_sha256"),
        F.max(F.when(F.col("whole"), F.col("found"))).alias("license"),
        F.count_if(~F.col("whole")).alias("n_notices"),
        F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("found")))).alias("notices"),
    ).drop("_row")
