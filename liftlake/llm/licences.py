"""License scans by canonical digests.

A text is brought to one canonical form: lower case, copyright lines gone, equivalent
spellings made one, everything but letters and digits a single space. The digest of
the whole form is looked up among those of known licences; so is that of each line and each paragraph,
since documents quote a notice as a line of its own, or wrapped over some. The known digests are a small
table (one row per notice), which the join broadcasts; lines and paragraphs are looked up inside their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence notices by identifier, equivalent spellings.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    # whole texts, without their copyright lines
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "0BSD-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}
SPELLINGS = {"licence": "license", "licenced": "licensed", "organisation": "organization", "favour": "favor", "whilst": "while", "v": "version"}
_COPYRIGHT = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"


def digest(text: Column) -> Column:
    """Digest of the canonical form. Never null, or the join would test it in a filter of its own and compute it twice."""
    return F.coalesce(F.sha2(canonical(text), 256), F.lit(""))


def canonical(text: Column) -> Column:
    """The canonical form; null stays null."""
    form = F.regexp_replace(F.lower(text), _COPYRIGHT, " ")
    form = F.regexp_replace(form, r"[^\p{L}\p{N}]+", " ")
    form = F.concat(F.lit(" "), F.trim(form), F.lit(" "))
    for other, one in SPELLINGS.items():
        form = F.replace(form, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(form)


def known_digests(spark: SparkSession, notices: dict[str, str] = NOTICES) -> DataFrame:
    """license, digest and length of the canonical form of each notice."""
    rows = spark.createDataFrame(list(notices.items()), "license string, notice string")
    return rows.select("license", digest(F.col("notice")).alias("digest"), F.length(canonical(F.col("notice"))).alias("form_chars"))


def license_report(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, license (of the entire text, else null), n_license_lines, line_licenses, paragraph_licenses (sorted, distinct, comma-joined).

    A paragraph lies between empty lines. Null and empty texts: null, 0, "", "". Each row stands for itself, also where a doc_id is null or repeated.
    A line shorter than half of the shortest notice is not looked up, since no digest can be its own.
    """
    known = known_digests(docs.sparkSession, notices)
    shortest = min(len(n) for n in notices.values()) // 2
    # as many entries as notices
    names = F.create_map(*[F.lit(x) for r in known.select("digest", "license").collect() for x in (r.digest, r.license)])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = lambda cut: F.filter(F.split("text", cut), lambda part: F.length(part) >= shortest)
    looked = lambda cut: F.filter(F.transform(parts(cut), lambda part: names[digest(part)]), lambda name: name.isNotNull())
    # one projection a step: inside one expression the digests would be computed again for each mention
    texts = texts.withColumn("lines", looked("\n")).withColumn("paragraphs", looked(r"\n[ \t\r]*\n"))
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(found)), ",")
    rows = texts.select("doc_id", digest(F.col("text")).alias("digest"), F.size("lines").cast("long").alias("n_license_lines"), joined("lines").alias("line_licenses"), joined("paragraphs").alias("paragraph_licenses"))
    rows = rows.join(F.broadcast(known.select("digest", "license")), "digest", "left")
    return rows.select("doc_id", "license", "n_license_lines", "line_licenses", "paragraph_licenses")
