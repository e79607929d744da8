"""Licence scan by canonical digest: a text is a known licence if its normal form has a known digest.

The normal form drops copyright lines, case and punctuation and unifies spellings. Whole texts are looked up, and
every line as a text of its own, so one-line notices are found. Both are hash joins on SHA-256 digests with a
table of known texts, which Spark broadcasts or shuffles as its size allows.
"""

from __future__ import annotations

import re
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

COPYRIGHT = "(?im)^[ \\t]*(?:copyright\\b|\\(c\\)|©|all rights reserved)[^\\n]*$"
PUNCTUATION = "[^\\p{L}\\p{N}]+"
#: Equivalent spellings, as patterns on lower-cased words and their replacement.
SPELLINGS = [
    ("\\blicenc(e|es|ed|ing|ee|ees|or|ors)\\b", "licens$1"),
    ("\\bsub licens", "sublicens"),
    ("\\bnon commercial", "noncommercial"),
    ("\\bcopyright owner", "copyright holder"),
    ("\\b(acknowledg|judg)ement", "$1ment"),
    ("\\b(organi|recogni|authori|utili)s(e|es|ed|ing|ation|ations)\\b", "$1z$2"),
    ("\\b(fav|hon|lab|behavi)our", "$1or"),
    ("\\bhttps\\b", "http"),
]
#: Names of licences, and the phrases notices use for them.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
}
NOTICES = ["{}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}", "This work is licensed under the {}", "This project is licensed under the {}"]
WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies. " + WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + WARRANTY,
}


#: Longer licences, one file each, named by id. AGPL-3.0 and the CC BY family are known by their notices only.
FILES = Path(__file__).parent / "licenses"
END = "END OF TERMS AND CONDITIONS"
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"],
}
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.",
    "Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE {} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
#: Who is named by clause 3, as provider and as not liable.
BSD_PARTIES = [("copyright holder", "copyright holders", "copyright holder"), ("copyright holder", "copyright holders", "copyright holders"), ("University", "Regents", "Regents")]


def full_texts() -> list[tuple[str, str]]:
    """(license_id, text) of whole licences beyond ``TEXTS``: BSD with its usual numbering and parties, the files with and
    without what follows their terms, lines as given and paragraphs in one line, and short licences below their title."""
    rows = []
    for marks, (name, provider, liable) in product([("1.", "2.", "3."), ("(1)", "(2)", "(3)"), ("a.", "b.", "c."), ("*", "*", "*")], BSD_PARTIES):
        start, *clauses, end = BSD
        clauses = [f"{m} {c.format(name)}" for m, c in zip(marks, clauses)]
        end = end.format(provider, liable)
        rows += [("BSD-2-Clause", "\n".join([start, *clauses[:2], end])), ("BSD-3-Clause", "\n".join([start, *clauses, end]))]
    rows += [(i, f"{title}\n\n{text}") for i, text in [*TEXTS.items(), *rows] for title in TITLES[i]]
    for file in sorted(FILES.glob("*.txt")):
        whole = file.read_text("utf-8")
        for text in {whole, whole.split(END)[0] + END if END in whole else whole}:
            rows += [(file.stem, text), (file.stem, "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text)))]
    return rows


def known_texts(spark: SparkSession) -> DataFrame:
    """license_id, text of the built-in licences and notices. Any other table of this shape can take its place."""
    rows = [(i, notice.format(name)) for i, names in NAMES.items() for name in names for notice in NOTICES]
    return spark.createDataFrame(rows + list(TEXTS.items()) + full_texts(), "license_id string, text string")


def normal_form(text: Column) -> Column:
    out = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT, "")), PUNCTUATION, " "))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return out


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest (of the whole text's normal form), license_id (of the whole text), notices (array of the ids
    of licences whose text is a whole line).

    Null text: null digest, no licence. Texts whose normal form is empty match nothing. Several known ids with one
    normal form: the first by name. Repeated rows each get their row, and rows that share a doc_id share notices.
    """
    forms = known.select("license_id", normal_form(F.col("text")).alias("form")).filter("form <> ''").groupBy("form").agg(F.min("license_id").alias("license_id"))
    ids = forms.select(F.sha2("form", 256).alias("digest"), "license_id")
    lengths = sorted(r["n"] for r in forms.select(F.length("form").alias("n")).distinct().collect())
    base = docs.select("doc_id", "text")
    lines = base.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= min(lengths, default=0))
    lines = lines.select("doc_id", normal_form(F.col("line")).alias("form")).filter(F.length("form").isin(lengths))
    notices = lines.select("doc_id", F.sha2("form", 256).alias("digest")).join(ids, "digest").groupBy("doc_id").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))
    whole = base.select("doc_id", F.sha2(normal_form(F.col("text")), 256).alias("digest")).join(ids, "digest", "left")
    return whole.join(notices, "doc_id", "left").select("doc_id", "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
