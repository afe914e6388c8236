"""Licence scan by canonical digests: texts are normalised, and whole texts are joined with known licences by hash."""

from __future__ import annotations

import re
from functools import cache
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import literal_rows

#: Licence texts and notices, each as its publisher words it.
PERMIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = (
    ("MIT", "MIT License\n\n" + PERMIT),
    ("MIT", "The MIT License (MIT)\n\n" + PERMIT),
    ("MIT", PERMIT),
    ("ISC", "ISC License\n\n" + GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + NO_WARRANTY),
    ("ISC", GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + NO_WARRANTY),
    ("0BSD", GRANT + ".\n\n" + NO_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
)
#: Spellings that count as equal, after case and punctuation are gone.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"),
    ("noncommercial", "non commercial"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("https", "http"), ("organisation", "organization"), ("favour", "favor"),
)
#: Copyright lines of the table's SQL, and those without a year at once: a sign, a blank to fill in, a firm or group.
COPYRIGHT = r"^(copyright|c|©)( c| ©)?( copyright)?( \d{4}| ©|$)"
MORE_COPYRIGHT = r"^(portions )?(copyright (c|©|\d{4}|y{2,4}|x{4}|years?)|(c|©) copyright|©)( |$)"
GROUP_COPYRIGHT = (
    r"^(portions )?copyright (\S+ ){1,8}"
    r"(authors|contributors|corp|corporation|developers|foundation|gmbh|inc|incorporated|limited|llc|ltd|team)( all rights reserved)?$"
)
NO_GROUP = r"^(portions )?copyright (holders?|owners?|notices?|licenses?|laws?|and|or) "
#: Titles that BSD texts bear.
BSD_TITLES = ("", "BSD {n}-Clause License", "The BSD {n}-Clause License", "The {n}-Clause BSD License", "{n}-Clause BSD License")
THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n\n"
)


@cache
def whole_texts() -> tuple[tuple[str, str], ...]:
    """Whole licences from the folder ``licence_texts`` (name up to a ~), also without the appendix on how to apply
    them; BSD texts with and without title, numbers and the line on rights."""
    out, bsd = [], []
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        licence, text = path.stem.split("~")[0], path.read_text(encoding="utf-8")
        if licence.startswith("BSD"):
            body = text[text.index("Redistribution and use") :]
            bsd.append((licence, body))
            if licence == "BSD-2-Clause":
                bsd.append(("BSD-3-Clause", body.replace("THIS SOFTWARE IS", THIRD + "THIS SOFTWARE IS", 1)))
            continue
        out.append((licence, text))
        out += [(licence, text[: m.start()]) for m in [re.search(r"(?im)^\W*(appendix: )?how to apply (the|these) ", text)] if m]
    for (licence, body), title, rights, numbers, many in product(bsd, BSD_TITLES, ("", "All rights reserved.\n"), (True, False), (True, False)):
        body = body if numbers else re.sub(r"(?m)^\d\. ", "", body)
        body = body.replace("COPYRIGHT HOLDER OR", "COPYRIGHT HOLDERS OR") if many else body
        out.append((licence, title.format(n=licence[4]) + "\n" + rights + body))
    return tuple(out)


def spelled(text: Column) -> Column:
    """A text of words in one spelling."""
    out = F.concat(F.lit(" "), text, F.lit(" "))
    for old, new in SPELLINGS * 2:  # twice, as neighbours share the space between them
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def canonical_lines(text: Column) -> Column:
    """Lines of a text without case, punctuation, equivalent spellings and copyright lines; empty lines are gone."""
    line = lambda raw: spelled(F.trim(F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}©]+", " ")))
    rights = lambda x: x.rlike(COPYRIGHT) | x.rlike(MORE_COPYRIGHT) | (x.rlike(GROUP_COPYRIGHT) & ~x.rlike(NO_GROUP))
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line), lambda x: (x != "") & ~rights(x))


def whole_digest(lines: Column) -> Column:
    """Digest of a whole text from its canonical lines; spellings of several words may stand across their ends."""
    return F.md5(spelled(F.concat_ws(" ", lines)))


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """digest, licence: one row per known text (``KNOWN`` and the whole texts, or given ones), from the same
    normalisation."""
    rows = literal_rows(spark, ["licence", "text"], [tuple(k) for k in known or KNOWN + whole_texts()])
    digest = whole_digest(canonical_lines(F.col("text")))
    return rows.select(digest.alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known=None) -> DataFrame:
    """doc_id, digest, licence (the whole text is a known one, else null), notice (licence of the first line that is a
    known text, else null) and n_notices of every document.

    Line breaks inside a licence do not matter. Null and empty texts and texts of copyright lines only have the
    digest of the empty text and no licence; repeated rows give repeated results; other columns are not read. The
    known texts are an argument of the caller, so their digests may be broadcast.
    """
    found = known_digests(docs.sparkSession, known).collect()
    digests = literal_rows(docs.sparkSession, ["digest", "licence"], [tuple(r) for r in sorted(found)])
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("_lines"))
    marked = lines.select("doc_id", whole_digest(F.col("_lines")).alias("digest"), F.transform("_lines", F.md5).alias("_digests"))
    marked = marked.withColumn("_found", F.filter("_digests", lambda d: d.isin([r["digest"] for r in found])))
    marked = marked.select("doc_id", "digest", F.size("_found").cast("long").alias("n_notices"), F.try_element_at("_found", F.lit(1)).alias("_first"))
    marked = marked.join(F.broadcast(digests), "digest", "left")
    first = digests.select(F.col("digest").alias("_first"), F.col("licence").alias("notice"))
    return marked.join(F.broadcast(first), "_first", "left").select("doc_id", "digest", "licence", "notice", "n_notices")


def _sql() -> str:
    """The same in SQL; all known texts are normalised by it, too."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def spelled(text: str) -> str:
        out = f"(' ' || {text} || ' ')"
        for old, new in SPELLINGS * 2:
            out = f"replace({out}, ' {old} ', ' {new} ')"
        return f"trim({out})"

    line = spelled("trim(regexp_replace(lower(l), '[^\\p{L}\\p{N}©]+', ' ', 'g'))")
    matches = lambda pattern: f"regexp_matches(l, {quote(pattern)})"
    norm = (
        f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: {line}), lambda l: l <> '' and not {matches(COPYRIGHT)}"
        f" and not {matches(MORE_COPYRIGHT)} and not ({matches(GROUP_COPYRIGHT)} and not {matches(NO_GROUP)}))"
    )
    whole = f"md5({spelled("array_to_string(lines, ' ')")})"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN + whole_texts())
    return f"""
with known(licence, text) as (values {values}),
n as (select licence, {norm} as lines from known),
k as (select {whole} as digest, min(licence) as licence from n group by 1),
d as (select doc_id, {norm} as lines from documents),
m as (
    select doc_id, {whole} as digest,
        list_filter(list_transform(lines, lambda l: md5(l)), lambda x: list_contains(known_digests, x)) as found
    from d, (select list(digest) as known_digests from k)
)
select m.doc_id, m.digest, k.licence, f.licence as notice, len(found)::bigint as n_notices
from m left join k on k.digest = m.digest left join k as f on f.digest = found[1]
"""


SQL = _sql()
