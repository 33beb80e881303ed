"""Licence scans by canonical digests.

Texts are brought to one canonical form (case, spelling, copyright lines, punctuation and white space)
and hashed; a hash join with the digests of known licences then finds whole texts that are one. Units
are the whole document, its paragraphs and its lines, so that a licence or notice that stands in a
document as a whole paragraph or line is found too; parts of a unit never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandsieve.llm.common import ascii_lower

# Texts and notices of common licences, as published by their stewards.
KNOWN = {
    "MIT": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "SPDX-License-Identifier: ISC",
    ],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
# Licences one may not train on without asking.
RESTRICTED = ["GPL-3.0", "CC-BY-NC-4.0"]
# Spellings that count as the same, after lower-casing.
EQUIVALENT = {
    "licence": "license",
    "organisation": "organization",
    "noncommercial": "non commercial",
    "merchantibility": "merchantability",
    "https": "http",
    "copyright owner": "copyright holder",
    "©": "(c)",
}


def _replaced(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def canonical_lines(text: Column) -> Column:
    """Canonical form that keeps line breaks: case, spellings, no copyright lines; runs of anything but
    letters and digits are one space."""
    text = _replaced(ascii_lower(text), EQUIVALENT)
    owned = r"(?m)^[^\p{L}\p{N}(]*(copyright\b|\(c\))[^\n]*(19|20)\d\d[^\n]*$|^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
    may_be_owned = text.contains("copyright") | text.contains("(c)") | text.contains("all rights reserved")
    text = F.when(may_be_owned, F.regexp_replace(text, owned, "")).otherwise(text)
    return F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")


def joined(lines: Column) -> Column:
    """Canonical form of a unit of canonical lines: without breaks."""
    return F.trim(F.regexp_replace(lines, r" ?\n[ \n]*", " "))


def digest(canonical_text: Column) -> Column:
    return F.sha2(canonical_text.cast("binary"), 256)


def known_digests(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license): a fixed list, a few rows for each licence."""
    rows = sorted({(name, text) for name, texts in (known or KNOWN).items() for text in texts})
    table = spark.createDataFrame(rows, "license string, text string")
    return table.select(digest(joined(canonical_lines(F.col("text")))).alias("digest"), "license").distinct()


def find(docs: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document row with a licence, and licence: doc_id, license, unit, places.

    ``unit`` is the largest unit that is the licence as a whole (``text``, ``paragraph`` or ``line``),
    ``places`` says how many units are. Null and empty texts, and units without a letter or digit,
    match nothing. Repeated rows without an id of their own count together. Only doc_id and text are
    read; an empty table gives an empty result.
    """
    lines = docs.select(docs["doc_id"], docs["text"].alias("text")).where("text IS NOT NULL").select("doc_id", canonical_lines(F.col("text")).alias("low"))
    units = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), joined(F.col("low")).alias("part"))),
        F.transform(F.split("low", r"\n *\n"), lambda p: F.struct(F.lit(1).alias("rank"), joined(p).alias("part"))),
        F.transform(F.split("low", r"\n"), lambda p: F.struct(F.lit(2).alias("rank"), F.trim(p).alias("part"))),
    )
    hashed = lines.select("doc_id", F.inline(units)).where("part <> ''").select("doc_id", "rank", digest(F.col("part")).alias("digest"))
    met = hashed.join(F.broadcast(known_digests(docs.sparkSession, known)), "digest")
    named = F.element_at(F.array(F.lit("text"), F.lit("paragraph"), F.lit("line")), F.col("rank") + 1)
    return (
        met.groupBy("doc_id", "license", "rank")
        .agg(F.count(F.lit(1)).alias("places"))
        .groupBy("doc_id", "license")
        .agg(F.min(F.struct("rank", "places")).alias("first"))
        .select("doc_id", "license", F.col("first.rank").alias("rank"), F.col("first.places").alias("places"))
        .select("doc_id", "license", named.alias("unit"), "places")
        .withColumn("restricted", F.col("license").isin(RESTRICTED))
    )
